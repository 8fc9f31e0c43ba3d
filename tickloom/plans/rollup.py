"""Nightly reports from mergeable state: partial aggregates of a symbol-day, merged over any range of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import finite
from tickloom.operators.ic import ic_table, signal_pairs
from tickloom.operators.profile import unpivot
from tickloom.operators.quality import minute_coverage
from tickloom.operators.ranks import value_bucket
from tickloom.session import stage

SHAPES = {
    "moments": "symbol string, metric string, n long, mean double, m2 double, low double, high double, date date",
    "buckets": "symbol string, metric string, bucket long, n long, low double, high double, date date",
    "ic": "symbol string, signal string, horizon int, ic double, hit_rate double, n_obs long, date date",
    "coverage": "symbol string, rows long, expected_minutes int, n_missing int, max_gap int, coverage double, status string, date date",
}


def moments(bars: DataFrame, metrics: list[str]) -> DataFrame:
    """Count, mean, squared deviation and range of each metric of a symbol-day."""
    d = unpivot(bars, ["symbol", "date"], metrics, "metric", "x").where(finite("x"))
    return d.groupBy("symbol", "date", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"),
        F.min("x").alias("low"), F.max("x").alias("high"))


def buckets(bars: DataFrame, metrics: list[str]) -> DataFrame:
    """Counts of each metric in fixed monotone buckets about 0.07 % wide, with the range that occurs in them."""
    d = unpivot(bars, ["symbol", "date"], metrics, "metric", "x").where(finite("x"))
    return d.groupBy("symbol", "date", "metric", value_bucket(F.col("x")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def daily_ic(measured: DataFrame, signals: list[str], horizons: list[int], min_obs: int = 20) -> DataFrame:
    """Rank correlation of each signal with the return ahead, within a symbol-day."""
    keys = ["symbol", "date", "signal", "horizon"]
    pairs = stage(signal_pairs(measured, ["symbol", "date"], signals, horizons), "day-pairs")
    return ic_table(pairs, keys, min_obs).select(*keys, "ic", "hit_rate", "n_obs")


def open_days(spark: SparkSession, bars: DataFrame, path: str) -> list:
    """Days of ``bars`` that the state lacks: read from the partition columns of both, one value a day."""
    found = [r.date for r in bars.select("date").distinct().collect()]
    try:
        done = {r.date for r in spark.read.schema(SHAPES["coverage"]).parquet(f"{path}/coverage").select("date").distinct().collect()}
    except Exception as e:  # the first night has no state yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    return sorted(d for d in found if d is not None and d not in done)


def update(spark: SparkSession, bars: DataFrame, path: str, metrics: list[str], measured=None, signals: list[str] = (),
           horizons: list[int] = (), days: list | None = None) -> list:
    """Adds the state of the days that ``path`` lacks (or of ``days`` again) and returns them; no other day is read.

    ``bars``: stored bars with features, partitioned by date. ``measured``: makes signals and returns ahead of the bars
    of whole days. Each table is partitioned by date and a day's partition is overwritten, so a repeated night gives
    the same state. Coverage is written last: a day counts as done when all its parts are there.
    """
    days = open_days(spark, bars, path) if days is None else days
    if not days:
        return []
    mine = bars.where(F.col("date").isin(days))
    parts = {"moments": moments(mine, metrics), "buckets": buckets(mine, metrics)}
    if measured is not None:
        parts["ic"] = daily_ic(measured(mine), list(signals), list(horizons))
    parts["coverage"] = minute_coverage(mine)
    for name, df in parts.items():
        columns = [c.split()[0] for c in SHAPES[name].split(", ")]
        df.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(
            f"{path}/{name}")
    return days


def state(spark: SparkSession, path: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    d = spark.read.schema(SHAPES[name]).parquet(f"{path}/{name}")
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    return d if end is None else d.where(F.col("date") <= F.lit(end).cast("date"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, std, low, high of any number of days: equal to those of all rows together."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    square = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * total / n
    return parts.groupBy(*keys).agg(
        n.alias("n"), (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1))).alias("std"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def merged_quantiles(parts: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from the buckets of any number of days: the rank is exact, the value lies in the right bucket."""
    from pyspark.sql import Window

    b = parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    w = Window.partitionBy(*keys)  # at most some hundred thousand buckets a key
    b = b.withColumns({"_upto": F.sum("n").over(w.orderBy("bucket")), "_all": F.sum("n").over(w)})

    def at(p):
        rank = F.floor((F.col("_all") - 1) * p)
        inside = F.coalesce(F.try_divide(rank - (F.col("_upto") - F.col("n")), F.col("n") - 1), F.lit(0.0))
        here = (F.col("_upto") - F.col("n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col("low") + (F.col("high") - F.col("low")) * inside))

    return b.groupBy(*keys).agg(*[at(p).alias(name) for name, p in probs.items()])


def merged_ic(parts: DataFrame) -> DataFrame:
    """(symbol, signal, horizon): mean of the days' coefficients, their deviation and t, and hits over all rows."""
    sd = F.stddev_samp("ic")
    return parts.groupBy("symbol", "signal", "horizon").agg(
        F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.count("ic").alias("n_days"),
        (F.sum(F.col("hit_rate") * F.col("n_obs")) / F.sum("n_obs")).alias("hit_rate"), F.sum("n_obs").alias("n_obs"),
        (F.avg("ic") / F.when(sd > 1e-12, sd) * F.sqrt(F.count("ic"))).alias("t_stat"))


def merged_coverage(parts: DataFrame) -> DataFrame:
    """(symbol): days, rows, expected and missing minutes, the longest gap, and the share of minutes present."""
    expected, missing = F.sum("expected_minutes"), F.sum("n_missing")
    return parts.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("rows").alias("n_rows"), expected.alias("expected_minutes"),
        missing.alias("n_missing"), F.max("max_gap").alias("max_gap"), (1 - missing / expected).alias("coverage"))
