"""Bars and rolling features that late ticks correct: versions of rows, the latest of which counts.

A bar is kept as partial aggregates that merge, one set a micro-batch. A tick of any age adds to its bar: the bar is
written again under the batch's number, and with it the features of all rows whose frames reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.columns import ist_date, ist_text, ist_tod
from tickloom.operators.bars import LADDER, bar_columns, tick_columns
from tickloom.operators.features import bar_features
from tickloom.streaming.jobs import _writer

REACH = 310
KEYS = ["symbol", "ts_sec"]
_LAST = ["last_price", "volume", "avg_price", "oi", "book_imbalance", "total_bid_qty", "total_ask_qty", "weighted_mid", *LADDER]
_MEANS = ("spread", "spread_bps", "book_imbalance", "price_impact")


def partial_bars(ticks: DataFrame, width: int = 1, tiebreak: str = "tick_id") -> DataFrame:
    """Aggregates of ticks per (symbol, ts_sec) that ``merged`` puts together.

    Structs as aggregates make Spark sort its input. The ticks are dealt by bar first, so that a task sorts its share of
    them and not the whole of a file, which may be small packed and large as ticks.
    """
    order = ["ts_local_ns", tiebreak]
    d = tick_columns(ticks, width).repartition(*KEYS).groupBy(*KEYS).agg(
        F.min(F.struct(*order, "last_price", "volume")).alias("first"), F.max(F.struct(*order, *_LAST)).alias("last"),
        F.max("last_price").alias("high"), F.min("last_price").alias("low"), F.count(F.lit(1)).alias("ticks"),
        F.max("spread").alias("spread_max"), F.var_pop("book_imbalance").alias("variance"),
        *[x for c in _MEANS for x in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))])
    return d.withColumn("date", ist_date())


def merged(partials: DataFrame) -> DataFrame:
    """Bars of any number of partial aggregates, as ``build_bars`` makes them of all ticks at once."""
    n, total = F.col("n_book_imbalance"), F.col("sum_book_imbalance")
    g = partials.groupBy(*KEYS, "date").agg(
        F.min("first").alias("_f"), F.max("last").alias("_l"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("ticks").alias("tick_count"), F.max("spread_max").alias("spread_max"),
        # squares around the parts' own means, and those of the means
        F.sum(F.col("variance") * n).alias("_within"), F.sum(total * total / n).alias("_between"),
        *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in _MEANS for k in ("sum", "n")])
    mean = {c: F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}") / F.col(f"n_{c}")) for c in _MEANS}
    square = F.greatest(F.col("_within") + F.col("_between") - total * total / n, F.lit(0.0))
    g = g.withColumns({
        "spread_mean": mean["spread"], "spread_bps": mean["spread_bps"], "imbalance_mean": mean["book_imbalance"],
        "price_impact": mean["price_impact"], "imbalance_std": F.when(n > 1, F.sqrt(square / (n - 1)))})
    return g.select("symbol", "ts_sec", *bar_columns()).withColumns({
        "date": ist_date(), "ist_tod": ist_tod().cast("int"), "ts_ist": ist_text()})


def reached(bars: DataFrame, reach: int = REACH) -> DataFrame:
    """Of the bars of whole symbol-days, with ``_new`` where one has changed: those that a change affects (``_out``) and
    the ``reach`` rows before each of these, which their frames need."""
    day = Window.partitionBy("symbol", "date").orderBy("ts_sec")
    d = bars.withColumns({
        "_out": F.max("_new").over(day.rowsBetween(-reach, 0)), "_near": F.max("_new").over(day.rowsBetween(-reach, reach))})
    return d.where("_near").drop("_near", "_new")


def corrected_stream(ticks: DataFrame, path: str, checkpoint: str, width: int = 1, every: str | None = None,
                     features: bool = True, tiebreak: str = "tick_id") -> StreamingQuery:
    """Writes ``path``/bars and ``path``/features, each with the batch's number as version, for ticks in any order.

    A batch adds its partial aggregates to ``path``/parts; the days that it touches are merged again, and only bars
    with a tick in the batch and rows within their reach are written. So a feed in order writes each row about once a
    batch in which its second is open, and a late tick costs its symbol-day. Folders are by date and batch: a repeated
    batch overwrites its own, and a batch reads no later one.
    """
    spark = ticks.sparkSession
    shape = partial_bars(spark.createDataFrame([], ticks.schema), width, tiebreak).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", batch long"

    def put(df: DataFrame, name: str, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{path}/{name}")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        put(partial_bars(batch, width, tiebreak), "parts", batch_id)
        stored = session.read.schema(schema).parquet(f"{path}/parts").where(F.col("batch") <= batch_id)
        new = stored.where(F.col("batch") == batch_id).select(*KEYS, "date")
        days = stored.join(new.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
        bars = merged(days).join(new.select(*KEYS, F.lit(True).alias("_new")), KEYS, "left").withColumn(
            "_new", F.coalesce("_new", F.lit(False)))
        put(bars.where("_new").drop("_new"), "bars", batch_id)
        if features:
            put(bar_features(reached(bars)).where("_out").drop("_out"), "features", batch_id)

    return _writer(ticks, checkpoint, every).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The current rows of ``path``/``name`` ("bars" or "features"): of each (symbol, ts_sec) the last version."""
    d = spark.read.parquet(f"{path}/{name}")
    rest = [c for c in d.columns if c not in (*KEYS, "batch")]
    return d.groupBy(*KEYS).agg(
        F.max_by(F.struct(*rest), "batch").alias("_r"), F.max("batch").alias("version"),
        F.count(F.lit(1)).alias("n_versions")).select(*KEYS, "_r.*", "version", "n_versions")
