"""Named queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_col(spec: str):
    name, _, how = spec.partition(":")
    c = F.col(name)
    if how.isdigit():
        d = c.cast("double")
        ok = ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
        return F.when(ok, F.round(d, int(how))).alias(name)
    kind = {"l": "bigint", "s": "string", "d": "date", "b": "boolean", "": None}[how]
    return c if kind is None else c.cast(kind).alias(name)


def _sql_col(spec: str) -> str:
    name, _, how = spec.partition(":")
    if how.isdigit():
        r = f"round({name}::DOUBLE, {how})"
        return (f"CASE WHEN isfinite({name}::DOUBLE) THEN "
                f"(CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END) END AS {name}")
    kind = {"l": "BIGINT", "s": "VARCHAR", "d": "DATE", "b": "BOOLEAN", "": None}[how]
    return name if kind is None else f"{name}::{kind} AS {name}"


def add(qid: str, fn: Callable[[SparkSession, str], DataFrame], cols: str, sql: str | None = None) -> None:
    """Registers a query.

    ``cols`` lists the result columns: ``name``, ``name:6`` (rounded), ``name:l``
    (long), ``:s`` (string), ``:d`` (date), ``:b`` (boolean). Both sides get the
    same projection, so they differ only in how the values were computed.
    """
    if qid in QUERIES:
        raise KeyError(f"{qid} is registered twice")
    specs = cols.split()
    QUERIES[qid] = lambda spark, d: fn(spark, d).select(*[_spark_col(c) for c in specs])
    if sql is not None:
        head, body = ("", sql)
        if sql.lstrip().upper().startswith("WITH "):
            cut = sql.rindex("\nSELECT")
            head, body = sql[:cut], sql[cut:]
        ORACLES[qid] = f"{head}\nSELECT {', '.join(_sql_col(c) for c in specs)} FROM ({body}\n) AS q"
