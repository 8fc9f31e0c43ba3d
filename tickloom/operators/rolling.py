"""Row frames in constant time per row.

Spark evaluates a sliding frame again for every row, which costs the frame's length
per row: three hundred steps for the longest frames here. Sums, means and deviations
follow instead from differences of running totals, and extremes from lags of doubled
length. Totals restart with every block of the span and are taken about the block's
first value, so they stay small and subtraction loses little; a frame whose values
are all equal has deviation zero exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import Span


@dataclass(frozen=True)
class Frame:
    """The n rows that end ``shift`` rows before the current one."""

    op: str            # sum, mean, std, stdp, min, max
    column: str
    n: int
    shift: int = 0
    full: bool = False  # NULL unless all n values are present

    @property
    def reach(self) -> int:
        return self.n + self.shift


def rolling(s: Span, df: DataFrame, frames: dict[str, Frame]) -> DataFrame:
    """Adds one column per frame. The span's halo must cover the longest frame."""
    if not s.blocked:
        raise ValueError("rolling frames need a span with blocks")
    moments = {f.column for f in frames.values() if f.op not in ("min", "max")}
    spread = {f.column for f in frames.values() if f.op in ("std", "stdp")}
    df, drop = _totals(s, df, sorted(moments), spread)
    made = {n: _moment(s, f) for n, f in frames.items() if f.op not in ("min", "max")}
    out = df.withColumns(made).drop(*drop) if made else df
    for n in sorted({f.n for f in frames.values() if f.op in ("min", "max")}):
        out = _extremes(s, out, n, {k: f for k, f in frames.items() if f.n == n and f.op in ("min", "max")})
    return out


def _totals(s: Span, df: DataFrame, columns: list[str], spread: set[str]) -> tuple[DataFrame, list[str]]:
    run = s.line.rowsBetween(Window.unboundedPreceding, 0)
    base, sums, drop = {}, {}, []
    for c in columns:
        x = F.col(c).cast("double")
        base[f"_c_{c}"] = F.first(x, ignorenulls=True).over(run)
        d = x - F.col(f"_c_{c}")
        sums[f"_n_{c}"] = F.count(x).over(run)
        sums[f"_s_{c}"] = F.sum(d).over(run)
        if c in spread:
            base[f"_p_{c}"] = F.lag(x).over(s.line)
            sums[f"_q_{c}"] = F.sum(d * d).over(run)
            sums[f"_d_{c}"] = F.count(F.when(x != F.col(f"_p_{c}"), 1)).over(run)
    if not columns:
        return df, []
    return df.withColumns(base).withColumns(sums), [*base, *sums]


def _moment(s: Span, f: Frame) -> Column:
    def upto(prefix: str, back: int) -> Column:
        c = F.col(f"_{prefix}_{f.column}")
        return F.coalesce(c if back == 0 else F.lag(c, back).over(s.line), F.lit(0))

    def between(prefix: str) -> Column:
        return upto(prefix, f.shift) - upto(prefix, f.shift + f.n)

    n, total = between("n"), between("s")
    first = F.col(f"_c_{f.column}")
    enough = n == f.n if f.full else n >= (2 if f.op == "std" else 1)
    if f.op == "sum":
        value = total + n * first
    elif f.op == "mean":
        value = (total + n * first) / F.when(n > 0, n)  # whole numbers stay exact
    else:
        moved = upto("d", f.shift) - upto("d", f.shift + f.n - 1)
        k = F.when(n > 1, n - 1) if f.op == "std" else F.when(n > 0, n)
        var = (between("q") - total * total / F.when(n > 0, n)) / k
        value = F.when(moved == 0, F.when(k.isNotNull(), 0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return F.when(enough, value)


def _extremes(s: Span, df: DataFrame, n: int, frames: dict[str, Frame]) -> DataFrame:
    """Extremes of n rows from extremes of 1, 2, 4, ... rows: log2(n) lags for all columns together."""
    pick = {"max": F.greatest, "min": F.least}
    df = df.withColumns({k: F.col(f.column).cast("double") for k, f in frames.items()})
    width = 1
    while width < n:
        step = min(width, n - width)
        df = df.withColumns({k: pick[f.op](F.col(k), s.lag(k, step)) for k, f in frames.items()})
        width += step
    return df.withColumns({k: s.lag(k, f.shift) for k, f in frames.items() if f.shift})


def rolling_corr(s: Span, df: DataFrame, name: str, x: str, y: str, n: int, shift: int = 0) -> DataFrame:
    """Correlation of the pairs in a frame; NULL where one side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    run = s.line.rowsBetween(Window.unboundedPreceding, 0)
    parts = {"_rn": F.count(a), "_ra": F.sum(a), "_rb": F.sum(b), "_raa": F.sum(a * a), "_rbb": F.sum(b * b), "_rab": F.sum(a * b)}
    df = df.withColumns({k: v.over(run) for k, v in parts.items()})

    def d(k):
        head = F.col(k) if shift == 0 else F.lag(k, shift).over(s.line)
        return F.coalesce(head, F.lit(0)) - F.coalesce(F.lag(k, shift + n).over(s.line), F.lit(0))

    df = df.withColumns({f"{k}w": d(k) for k in parts})
    m = F.when(F.col("_rnw") > 1, F.col("_rnw"))
    va = F.col("_raaw") - F.col("_raw") * F.col("_raw") / m
    vb = F.col("_rbbw") - F.col("_rbw") * F.col("_rbw") / m
    cov = F.col("_rabw") - F.col("_raw") * F.col("_rbw") / m
    tiny = 1e-12 * m
    out = cov / F.sqrt(F.when(va > tiny * 1e-12, va) * F.when(vb > tiny * 1e-12, vb))
    return df.withColumn(name, out).drop(*parts, *[f"{k}w" for k in parts])
