"""Structured Streaming jobs. Sources and sinks are tables; every job keeps its checkpoint in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tickloom.functions.columns import ist_date, ist_text, ist_tod
from tickloom.functions.symbols import instrument_class
from tickloom.operators.bars import bar_aggregates, bar_columns, build_bars, tick_columns
from tickloom.operators.options import strike_sets
from tickloom.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                files_per_batch: int = 1000) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def drain(query: StreamingQuery, seconds: float | None = None) -> StreamingQuery:
    """Waits for an available-now query, as long as it takes or ``seconds``, and raises what made it fail."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream {query.name or query.id} still runs after {seconds} s")
    return query


@contextmanager
def keyed_state(spark: SparkSession):
    """A stream started inside keeps its state in RocksDB, which keyed state needs; the session's own choice comes back.

    A query copies the session's settings when it starts.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def _writer(df: DataFrame, checkpoint: str, every: str | None, mode: str = "append"):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def tick_time(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("ts", F.timestamp_micros((F.col("ts_local_ns") / 1000).cast("long")))


def ingest(ticks: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Flat ticks to Parquet by date and symbol, one commit per trigger."""
    d = ticks.withColumn("date", ist_date(F.floor(F.col("ts_local_ns") / 1_000_000_000)))
    return _writer(d, checkpoint, every).partitionBy("date", "symbol").format("parquet").start(path)


def bar_stream(ticks: DataFrame, width: int = 1, late: str = "5 seconds", tiebreak: str = "tick_id") -> DataFrame:
    """Bars of a tick stream, emitted once the watermark has passed their end; later ticks are dropped."""
    d = tick_time(tick_columns(ticks, width)).withWatermark("ts", late)
    g = d.groupBy(F.window("ts", f"{width} seconds"), "symbol").agg(*bar_aggregates(tiebreak))
    sec = F.unix_timestamp("window.start")
    return g.select("symbol", sec.alias("ts_sec"), *bar_columns()).withColumns({
        "date": ist_date(), "ist_tod": ist_tod().cast("int"), "ts_ist": ist_text()})


def store(df: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    with keyed_state(df.sparkSession):
        return _writer(df, checkpoint, every, mode).format("parquet").start(path)


def closing_bars(ticks: DataFrame, stored: DataFrame, width: int = 1, late_seconds: float = 5.0) -> DataFrame:
    """The bars of a finished session that the stream still held: nothing passes the watermark after the last tick.

    ``ticks``: the session's stored ticks; ``stored``: the bars that the stream emitted; ``late_seconds``: the stream's
    delay. Bars that end at or below its last watermark are the stream's own to emit and are not made up for here.
    """
    mark = ticks.agg((F.max(F.expr("ts_local_ns div 1000000")) - int(late_seconds * 1000)).alias("_mark"))
    held = build_bars(ticks, width).join(F.broadcast(mark), (F.col("ts_sec") + width) * 1000 > F.col("_mark")).drop("_mark")
    return held.join(stored.select("symbol", "ts_sec"), ["symbol", "ts_sec"], "left_anti")


def split_late(ticks: DataFrame, path: str, checkpoint: str, late_seconds: float = 5.0, every: str | None = None) -> StreamingQuery:
    """Stores ticks with a flag for those behind the watermark of the batches before theirs."""
    d = tick_time(ticks)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        limit = None
        if batch_id > 0:
            seen = spark.read.schema("batch long, top timestamp").parquet(marks)
            limit = seen.where(F.col("batch") < batch_id).agg(F.max("top")).first()[0]
        is_late = F.lit(False) if limit is None else (
            F.unix_micros("ts") < F.unix_micros(F.lit(limit)) - int(late_seconds * 1_000_000))
        out = batch.withColumns({"is_late": is_late, "batch": F.lit(batch_id)})
        # a repeated batch overwrites its own partitions only
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/ticks")
        out.groupBy(F.lit(batch_id).cast("long").alias("batch")).agg(F.max("ts").alias("top")).write.mode("append").parquet(marks)

    return _writer(d, checkpoint, every).foreachBatch(write).start()


def strike_stream(spot: DataFrame, master: DataFrame, path: str, checkpoint: str, interval: float, each_side: int,
                  slot_seconds: int = 1800, min_shift: int = 2, late: str = "5 seconds", every: str | None = None) -> StreamingQuery:
    """Strike changes per underlying from a stream of spot ticks (underlying, ts, spot_price).

    Closed slots are stored by day; the changes of the days a batch touches are
    computed again from the stored slots, so a repeated batch gives the same table.
    Of ticks at the same time the highest price counts.
    """
    w = F.window("ts", f"{slot_seconds} seconds")
    slots = spot.withWatermark("ts", late).groupBy(w, "underlying").agg(F.max_by("spot_price", F.struct("ts", "spot_price")).alias("spot_price"))
    slots = slots.select("underlying", F.unix_timestamp("window.start").alias("ts_sec"), "spot_price").withColumn("date", ist_date())

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = batch.withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{path}/slots")
        stored = spark.read.schema("underlying string, ts_sec long, spot_price double, date date, batch int").parquet(f"{path}/slots")
        days = batch.select("date").distinct()
        changed = strike_sets(stored.join(days, "date", "left_semi").drop("date", "batch"), master, interval, each_side, slot_seconds, min_shift)
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/changes")

    return _writer(slots, checkpoint, every).foreachBatch(write).start()


def freshness_stream(ticks: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Latest tick and tick count per instrument class and batch."""
    d = tick_time(ticks).withColumn("class", instrument_class("symbol"))

    def write(batch: DataFrame, batch_id: int) -> None:
        g = batch.groupBy("class").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n_ticks"))
        g.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return _writer(d, checkpoint, every).foreachBatch(write).start()


def freshness(spark: SparkSession, path: str, as_of: F.Column | None = None) -> DataFrame:
    """Age of the latest tick per class, against ``as_of`` or now."""
    d = spark.read.parquet(path).groupBy("class").agg(F.max("latest").alias("latest"), F.sum("n_ticks").alias("n_ticks"))
    now = F.current_timestamp() if as_of is None else as_of
    return d.withColumn("age_seconds", F.unix_micros(now) / 1e6 - F.unix_micros("latest") / 1e6)


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"checkpoint-{name}")
