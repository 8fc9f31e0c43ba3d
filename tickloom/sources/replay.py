"""Recorded broker messages as a replayable stream: offsets, partitions and Arrow batches of a Python data source.

A recording is a folder of Parquet files with a message a row: ``feed`` ("depth" or "text"), ``ts_local_ns`` and ``body``
(JSON). Offsets count its rows, files in the order of their arrival, so a query that stops between two batches goes on
at the row behind the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tickloom.schema import RAW_TICK, conform
from tickloom.sources.ticks import flatten_depth, parse_text_levels

GROUP_BYTES = 16 << 20
MESSAGE = "offset long, feed string, ts_local_ns long, body string"


class Rows(InputPartition):
    def __init__(self, file: str, first: int, start: int, end: int):
        self.file, self.first, self.start, self.end = file, first, start, end


def _store(path: str):
    """The file system of a path and the path within it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class MessageReader(DataSourceStreamReader):
    """Offsets are rows of the recording. The driver lists files and reads the footers of new ones; a task reads whole row
    groups, as Arrow batches: one at least, and more until they hold ``rowsPerTask``. So no group is read twice."""

    def __init__(self, options):
        self.path, self.per_task = options["path"], int(options.get("rowsPerTask", "25000"))
        self.files: list[tuple[str, int, list[int]]] = []  # path, first offset, rows of each row group

    def _listed(self) -> int:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        store, path = _store(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        known = {f for f, _, _ in self.files}
        end = sum(sum(n) for _, _, n in self.files)
        for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.path)):
            if f.path not in known:
                with store.open_input_file(f.path) as source:
                    meta = pq.read_metadata(source)
                self.files.append((f.path, end, [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]))
                end += meta.num_rows
        return end

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self._listed()}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        if end["row"] > sum(sum(n) for _, _, n in self.files):
            self._listed()  # a batch that a restart repeats
        out = []
        for file, first, groups in self.files:
            low = at = first
            for i, n in enumerate(groups):
                at += n
                if at - low >= self.per_task or i == len(groups) - 1:
                    a, b = max(start["row"], low), min(end["row"], at)
                    if a < b:
                        out.append(Rows(file, first, a, b))
                    low = at
        return out

    def read(self, partition: Rows):
        import pyarrow as pa
        import pyarrow.parquet as pq

        with _store(self.path)[0].open_input_file(partition.file) as f:
            source, at = pq.ParquetFile(f), partition.first
            for g in range(source.num_row_groups):
                n = source.metadata.row_group(g).num_rows
                low, high = max(partition.start, at), min(partition.end, at + n)
                if low < high:
                    t = source.read_row_group(g, columns=["feed", "ts_local_ns", "body"]).slice(low - at, high - low)
                    yield from t.add_column(0, "offset", pa.array(range(low, high), pa.int64())).to_batches()
                at += n

    def commit(self, end: dict) -> None:
        """Nothing to give back: the recording stays."""

    def stop(self) -> None:
        pass


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker_recording"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(self.options)


def record(messages: DataFrame, path: str) -> None:
    """Adds messages (feed, ts_local_ns, body) to a recording, in row groups of a size that suits a task."""
    messages.select("feed", "ts_local_ns", "body").sortWithinPartitions("ts_local_ns").write.mode("append").option(
        "parquet.block.size", GROUP_BYTES).parquet(path)


def replay(spark: SparkSession, path: str, rows_per_task: int = 25_000) -> DataFrame:
    """The recording as a stream of (offset, feed, ts_local_ns, body): a batch has what has arrived since the last one."""
    spark.dataSource.register(Recording)
    return spark.readStream.format("broker_recording").option("path", path).option("rowsPerTask", rows_per_task).load()


def _parsed(messages: DataFrame, feed: str, schema: StructType | str) -> DataFrame:
    """(offset, ts_local_ns, m): the bodies of one feed that have a symbol.

    A filter on a parsed body would be pushed below it and parse every body a second time; a generator is not.
    """
    known = F.filter(F.array(F.from_json("body", schema)), lambda m: m["symbol"].isNotNull())
    return messages.where(F.col("feed") == feed).select("offset", "ts_local_ns", F.explode(known).alias("m"))


def depth_ticks(messages: DataFrame) -> DataFrame:
    """Flat ticks of the nested format, with the message's offset."""
    d = _parsed(messages, "depth", StructType([f for f in RAW_TICK if f.name != "ts_local_ns"]))
    return d.select("offset", "ts_local_ns", *[F.col(f"m.{f.name}") for f in RAW_TICK if f.name != "ts_local_ns"])


def text_ticks(messages: DataFrame, levels: int = 10) -> DataFrame:
    """Ticks of the text format: symbol, lp, v, bp1.., bq1.., sp1.., sq1.., all of them texts."""
    names = ["symbol", "lp", "v", *[f"{k}{i}" for i in range(1, levels + 1) for k in ("bp", "bq", "sp", "sq")]]
    d = _parsed(messages, "text", ", ".join(f"{n} string" for n in names))
    return parse_text_levels(d.select("offset", "ts_local_ns", "m.*"), levels)


def rejects(messages: DataFrame) -> DataFrame:
    """Messages of an unknown format, or whose body is no JSON object with a symbol."""
    symbol = F.get_json_object("body", "$.symbol")
    return messages.where(~F.col("feed").isin("depth", "text") | F.col("feed").isNull() | symbol.isNull())


def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flat ticks of both formats, rejects) of a batch of messages. The nested format fills the common columns."""
    # the feed comes first: a body of the other one is not searched for its symbol
    nested, text = (batch.where(F.col("feed") == f).where(F.get_json_object("body", "$.symbol").isNotNull()) for f in ("depth", "text"))
    flat = flatten_depth(depth_ticks(nested))
    return flat.unionByName(conform(text_ticks(text, 5), flat.schema)), rejects(batch)


def ingest_recording(messages: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Writes ``path``/ticks and ``path``/rejects, a partition a batch: a repeated batch overwrites its own."""
    from tickloom.streaming.jobs import _writer

    def write(batch: DataFrame, batch_id: int) -> None:
        ticks, bad = split(batch)
        for name, df in (("ticks", ticks), ("rejects", bad)):
            df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return _writer(messages, checkpoint, every).foreachBatch(write).start()
