"""Nightly batch: open symbol-days from raw ticks to stored bars with features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tickloom.functions.symbols import strip_contract
from tickloom.operators.bars import build_bars
from tickloom.operators.catalogue import open_jobs
from tickloom.operators.features import bar_features
from tickloom.session import stage
from tickloom.sources.storage import scan, write_bars


def backlog(raw: DataFrame, processed: DataFrame | None, min_rows: int = 10_000) -> DataFrame:
    """Symbol-days with ticks and without a complete result. Both tables have symbol and date."""
    jobs = raw.select("symbol", "date").distinct()
    if processed is None:
        return jobs.withColumn("reason", F.lit("missing"))
    done = processed.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n_rows"))
    return open_jobs(jobs, done, min_rows)


def process(ticks: DataFrame, jobs: DataFrame, width: int = 1, tiebreak: str = "tick_id") -> DataFrame:
    """Bars with features of the open symbol-days, in one plan."""
    mine = ticks.join(jobs.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
    return bar_features(build_bars(mine, width, tiebreak))


STORED = StructType([StructField("date", DateType()), StructField("base", StringType()), StructField("symbol", StringType())])


def run(spark: SparkSession, raw_path: str, out_path: str, schema: StructType, start: str | None = None,
        end: str | None = None, first: bool = False, width: int = 1, min_rows: int = 10_000) -> None:
    """Reads raw ticks, processes the backlog of the date range and overwrites those (date, base) partitions.

    ``schema``: that of the raw ticks, with date and symbol. A partition holds all contracts of a base, so every
    contract of an open (date, base) is built again.
    """
    ticks = scan(spark, raw_path, schema, start, end)
    done = None if first else scan(spark, out_path, STORED, start, end, key="base")
    pairs = stage(ticks.select("symbol", "date").distinct(), "pairs")  # read once, from the partition columns
    jobs = backlog(pairs, done, min_rows).select(strip_contract("symbol").alias("base"), "date").distinct()
    every = pairs.withColumn("base", strip_contract("symbol"))
    write_bars(process(ticks, every.join(jobs, ["base", "date"], "left_semi"), width), out_path)
