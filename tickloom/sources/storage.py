"""Partitioned tables: ticks by (date, symbol), bars by (date, base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions.columns import in_session, ist_date
from tickloom.functions.symbols import strip_contract
from tickloom.schema import ensure_columns


def write_partitioned(df: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """Overwrites only the partitions present in ``df``.

    Rows of a partition are spread by range of the sort columns, so a symbol with a
    large share is written by many tasks instead of one.
    """
    (
        df.repartitionByRange(*by, *sort).sortWithinPartitions(*by, *sort)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy(*by).parquet(path)
    )


def write_ticks(ticks: DataFrame, path: str) -> None:
    sec = F.floor(F.col("ts_local_ns") / 1_000_000_000)
    write_partitioned(ticks.withColumn("date", ist_date(sec)), path, ["date", "symbol"], ["ts_local_ns"])


def write_bars(bars: DataFrame, path: str) -> None:
    write_partitioned(bars.withColumn("base", strip_contract("symbol")), path, ["date", "base"], ["ts_sec"])


def scan(spark: SparkSession, path: str, schema: StructType, start: str | None = None,
         end: str | None = None, symbols: list[str] | None = None, key: str = "symbol",
         defaults: dict[str, object] | None = None) -> DataFrame:
    """Partition-pruned scan with the table's schema, so no footers are read before it prunes.

    Columns that the files of a day lack are null there, or have the value in ``defaults``.
    """
    df = spark.read.schema(schema).parquet(path).withColumn("date", F.col("date").cast("date"))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    df = df.where(F.col(key).isin(symbols)) if symbols else df
    return ensure_columns(df, defaults) if defaults else df


def load_day(spark: SparkSession, path: str, schema: StructType, symbol: str, date: str, market_hours_only: bool = True,
             defaults: dict[str, object] | None = None) -> DataFrame:
    df = scan(spark, path, schema, date, date, [symbol], "base", defaults)
    df = df.where(in_session("symbol", F.col("ist_tod"))) if market_hours_only else df
    return df.orderBy("ts_sec")


def load_range(bars: DataFrame, start: str, end: str, market_hours_only: bool = True) -> DataFrame:
    """Bars of a date range from one source per (base, date): see ``catalogue.best_source``."""
    from tickloom.operators.catalogue import best_source

    df = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    keep = best_source(df.select("base", "contract", "layout", "date").distinct())
    df = df.join(keep.select("base", "date", "contract", "layout"), ["base", "date", "contract", "layout"])
    return df.where(in_session("base")) if market_hours_only else df


def load_table(df: DataFrame, name: str, path: str, skip_dates: list[str] | None = None) -> None:
    """Replaces a catalog table; dates in an old layout may be left out."""
    if skip_dates:
        df = df.where(~F.col("date").isin([F.lit(d).cast("date") for d in skip_dates]))
    df.write.mode("overwrite").option("path", path).saveAsTable(name)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SQL over DataFrames passed by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_params(docs: DataFrame, column: str = "json") -> DataFrame:
    """JSON objects keyed by symbol to rows (symbol, key, value); keys starting with _ are metadata."""
    outer = F.from_json(column, "MAP<STRING, STRING>")
    rest = [c for c in docs.columns if c != column]
    d = docs.select(*rest, F.explode(outer).alias("symbol", "_v")).where(~F.col("symbol").startswith("_"))
    inner = F.from_json("_v", "MAP<STRING, DOUBLE>")
    return d.select(*rest, "symbol", F.explode(inner).alias("key", "value"))


def expired_partitions(parts: DataFrame, as_of: str, keep_days: int) -> DataFrame:
    """Partitions older than the retention; nothing is deleted here."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    return parts.withColumn("age_days", age).where(F.col("age_days") > keep_days)
