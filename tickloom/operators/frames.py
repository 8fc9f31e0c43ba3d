"""Row frames over bars.

Bars hold at most 86,400 rows per symbol and day, so a frame that is partitioned
by (symbol, date) has a fixed upper size whatever the symbol's share of the data.
A frame that may cross days has no such limit. For it the rows of a symbol get a
running position, are cut into blocks, and the rows a frame can reach into a
neighbouring block are copied there. Every task then sees whole blocks. Frames of
one day may be cut the same way, without another shuffle, for ``rolling``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# with the halo of the longest frame a block stays below the 4,096 rows that Spark's
# window operator keeps in memory before it turns to its spillable buffer
BLOCK_ROWS = 3600


def with_position(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                  name: str = "_pos") -> DataFrame:
    """0-based position of each row within ``keys``, without one sort per key.

    Counting per (keys, chunk) first gives the start of every chunk; only rows of
    one chunk are sorted together. ``chunk`` must be monotone in ``order``.
    """
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, chunk, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    return (
        df.join(starts, [*keys, chunk])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_start")
    )


@dataclass(frozen=True)
class Span:
    df: DataFrame
    part: tuple[str, ...]
    order: str
    blocked: bool

    @property
    def line(self):
        return Window.partitionBy(*self.part).orderBy(self.order)

    def last(self, n: int):
        return self.line.rowsBetween(-(n - 1), 0)

    def before(self, n: int):
        return self.line.rowsBetween(-n, -1)

    @property
    def pos(self) -> Column:
        """0-based position of the row in its sequence."""
        return F.col("_pos") if self.blocked else F.row_number().over(self.line) - 1

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.line)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(x, n).over(self.line)

    def full(self, fn, x: str, n: int) -> Column:
        """``fn`` over the last n rows, NULL unless all n values are present."""
        w = self.last(n)
        return F.when(F.count(F.col(x)).over(w) == n, fn(F.col(x)).over(w))

    def close(self, df: DataFrame) -> DataFrame:
        return df.where("_own").drop("_own", "_blk", "_pos") if self.blocked else df


def span(df: DataFrame, cross_day: bool = False, back: int = 0, ahead: int = 0,
         block_rows: int = BLOCK_ROWS, blocks: bool = False) -> Span:
    """Frames by (symbol, date), or across days with frames up to ``back``/``ahead`` rows.

    ``back`` must cover the whole reach of nested frames, e.g. 361 for a 300-row
    deviation of a 60-row mean of a difference. ``blocks`` cuts single days as well.
    """
    if not cross_day and not blocks:
        return Span(df, ("symbol", "date"), "ts_sec", False)
    if cross_day:
        keys, d = ("symbol",), with_position(df, ["symbol"], "date", ["ts_sec"])
    else:
        keys = ("symbol", "date")
        d = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ts_sec")) - 1)
    b = F.lit(block_rows)
    first = F.greatest(F.lit(0), F.floor((F.col("_pos") - ahead) / b)).cast("long")
    final = F.floor((F.col("_pos") + back) / b).cast("long")
    d = d.withColumn("_blk", F.explode(F.sequence(first, final)))
    d = d.withColumn("_own", F.col("_blk") == F.floor(F.col("_pos") / b))
    return Span(d, (*keys, "_blk"), "_pos", True)
