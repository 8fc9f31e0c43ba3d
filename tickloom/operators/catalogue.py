"""Which data exists: sources per day, active contracts, open jobs, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.symbols import (
    INDEX_BASES, SUFFIX, contract_expiry, contract_month, instrument_class, strip_contract,
)


def best_source(files: DataFrame, symbol: str | None = None) -> DataFrame:
    """One source per (base, date): new layout, else the exact contract, else the latest expiry."""
    exact = F.col("contract") == F.lit(symbol) if symbol else F.lit(False)
    rank = F.when(F.col("layout") == "new", 0).when(exact, 1).otherwise(2)
    w = Window.partitionBy("base", "date").orderBy(
        "priority", F.desc_nulls_last(contract_month("contract")), F.desc("contract"))
    return (
        files.withColumn("priority", rank).withColumn("_r", F.row_number().over(w))
        .where("_r = 1").drop("_r")
    )


def active_bases(files: DataFrame, start: str, end: str, exclude_index: bool = True) -> DataFrame:
    d = files.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    d = d.select(strip_contract("contract").alias("base")).distinct()
    return d.where(~F.col("base").isin(*INDEX_BASES)) if exclude_index else d


def active_contracts(files: DataFrame, start: str, end: str) -> DataFrame:
    """Latest unexpired contract with data in the range, per underlying, without index futures."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = files.where(F.col("contract").rlike(SUFFIX) & F.col("date").between(lo, hi))
    d = d.select("contract").distinct().withColumns({
        "base": strip_contract("contract"), "expiry": contract_expiry(contract_month("contract"))})
    d = d.where((F.col("expiry") >= lo) & ~F.col("base").isin(*INDEX_BASES))
    w = Window.partitionBy("base").orderBy(F.desc("expiry"), F.desc("contract"))
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def open_jobs(raw: DataFrame, processed: DataFrame, min_rows: int = 10_000) -> DataFrame:
    """Raw (symbol, date) without a result, and those whose result is too short."""
    key = ["symbol", "date"]
    missing = raw.select(*key).distinct().join(processed.select(*key), key, "left_anti").withColumn(
        "reason", F.lit("missing"))
    short = raw.select(*key).distinct().join(
        processed.where(F.col("n_rows") < min_rows).select(*key), key, "left_semi").withColumn(
        "reason", F.lit("incomplete"))
    return missing.unionByName(short)


def job_sets(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Set algebra over jobs: pending, done and all."""
    a, b = raw.select("symbol", "date"), processed.select("symbol", "date")
    return (
        a.subtract(b).withColumn("set", F.lit("pending"))
        .unionByName(a.intersect(b).withColumn("set", F.lit("done")))
        .unionByName(a.union(b).distinct().withColumn("set", F.lit("all")))
    )


def inventory(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.countDistinct("date").alias("n_dates"),
        F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"),
        F.avg("close").alias("avg_price"), F.avg("spread_mean").alias("avg_spread"),
        F.avg("tick_count").alias("avg_ticks"))


def class_coverage(files: DataFrame, good: int = 10) -> DataFrame:
    """Files per class and day, with a verdict on the day."""
    n = F.col("n_files")
    return (
        files.withColumn("class", instrument_class("contract")).groupBy("date", "class")
        .agg(F.sum("n_files").alias("n_files"), F.countDistinct("contract").alias("n_symbols"))
        .withColumn("status", F.when(n > good, "GOOD").when(n > 0, "PARTIAL").otherwise("NO DATA"))
    )


def most_dates(files: DataFrame, top: int = 20) -> DataFrame:
    return (
        files.groupBy("symbol").agg(F.array_sort(F.collect_set("date")).alias("dates"))
        .withColumn("n_dates", F.size("dates")).orderBy(F.desc("n_dates"), "symbol").limit(top)
    )
