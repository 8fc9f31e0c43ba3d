"""Running totals and maxima of sequences of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OPS = {"sum": F.sum, "max": F.max}


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str],
            columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds inclusive running aggregates: {name: ("sum" | "max", column)}.

    Chunks are reduced first and only their totals are scanned per key, so rows of
    one key are sorted chunk by chunk in separate tasks. ``chunk`` must be monotone
    in ``order``.
    """
    per = df.groupBy(*keys, chunk).agg(*[_OPS[o](c).alias(f"_t{i}") for i, (o, c) in enumerate(columns.values())])
    upto = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, chunk, *[
        _OPS[o](f"_t{i}").over(upto).alias(f"_b{i}") for i, (o, _) in enumerate(columns.values())])
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.join(before, [*keys, chunk])
    made = {}
    for i, (name, (o, c)) in enumerate(columns.items()):
        here = _OPS[o](c).over(inside)
        made[name] = F.coalesce(F.col(f"_b{i}"), F.lit(0)) + here if o == "sum" else F.greatest(F.col(f"_b{i}"), here)
    return d.withColumns(made).drop(*[f"_b{i}" for i in range(len(columns))])
