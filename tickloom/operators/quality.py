"""Minute coverage of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import CURRENCY_PATTERN, CURRENCY_SESSION, EQUITY_SESSION, ist_tod


def minute_coverage(bars: DataFrame, min_coverage: float = 0.5, gap_minutes: int = 5) -> DataFrame:
    """Present against expected minutes of every symbol and day.

    A session has at most 480 minutes, so the minutes of a day fit one small array
    and neither a grid nor a join is needed.
    """
    fx = F.col("symbol").rlike(CURRENCY_PATTERN)
    lo = F.when(fx, CURRENCY_SESSION[0] // 60).otherwise(EQUITY_SESSION[0] // 60)
    hi = F.when(fx, CURRENCY_SESSION[1] // 60).otherwise(EQUITY_SESSION[1] // 60)
    minute = F.floor(ist_tod() / 60).cast("int")
    inside = (minute >= lo) & (minute < hi)
    g = bars.groupBy("symbol", "date").agg(
        F.count(F.when(inside, 1)).alias("rows"),
        F.array_sort(F.collect_set(F.when(inside, minute))).alias("present"))
    g = g.withColumns({"_lo": lo, "_hi": hi})
    marks = F.concat(F.array(F.col("_lo") - 1), F.col("present"), F.array(F.col("_hi")))
    steps = F.zip_with(F.slice(marks, 2, F.size(marks) - 1), F.slice(marks, 1, F.size(marks) - 1),
                       lambda a, b: a - b - 1)
    expected = F.col("_hi") - F.col("_lo")
    g = g.withColumns({
        "expected_minutes": expected,
        "missing": F.array_except(F.sequence(F.col("_lo"), F.col("_hi") - 1), F.col("present")),
        "max_gap": F.array_max(steps),
        "coverage": F.size("present") / expected,
    })
    low, large = F.col("coverage") < min_coverage, F.col("max_gap") >= gap_minutes
    status = F.concat_ws(
        ", ", F.when(low, "LOW_COVERAGE"), F.when(large, "LARGE_GAP").when(F.size("missing") > 0, "MINOR_GAPS"))
    return g.withColumns({
        "n_missing": F.size("missing"), "low_coverage": low, "large_gap": large,
        "status": F.when(F.col("rows") == 0, "NO_DATA_IN_MARKET_HOURS").when(status == "", "OK").otherwise(status),
    }).drop("_lo", "_hi", "present")


def health(coverage: DataFrame, expected_symbols: int) -> DataFrame:
    """Daily roll-up of the coverage report."""
    def n(c):
        return F.sum(c.cast("int"))

    s = F.col("status")
    g = coverage.groupBy("date").agg(
        F.count(F.lit(1)).alias("found"), n(s == "OK").alias("ok"), n(s.contains("NO_DATA")).alias("no_data"),
        n(F.col("low_coverage")).alias("low_coverage"), n(F.col("large_gap")).alias("large_gaps"),
        n(s.contains("MINOR_GAPS")).alias("minor_gaps"))
    return g.withColumn(
        "overall",
        F.when(F.col("found") < expected_symbols * 0.80, "CRITICAL")
        .when((F.col("found") < expected_symbols * 0.95) | (F.col("large_gaps") > 0) | (F.col("low_coverage") > 0), "WARNING")
        .otherwise("HEALTHY"))
