"""Helpers the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below spark.checkpoint.dir and reads it back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A table to join with: broadcast if it is counted to be small, rows being some numbers each."""
    df = staged(df, "few")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it different from all columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` as they stand, whatever their names, less some."""
    gone = {c.lower() for c in without}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def row_key(*columns: str) -> Column:
    """One 128-bit name of a row's content; repeated rows share it, null has a name of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


def place(*columns: str) -> Column:
    """A number from 0 to 1 that the hash of a row's values gives it."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / (1 << 31)


def kept_in_worker(name, version, make):
    """``make()`` once per Python worker process and version; reused workers find it again in later tasks.

    A worker holds one object at a time: what an earlier stage left goes when the next one makes its own.
    """
    import sys

    store = sys.__dict__.setdefault("_tickloom_kept", {})
    if name not in store or store[name][0] != version:
        store.clear()
        store[name] = version, make()
    return store[name][1]


class Shared:
    """A value broadcast to all workers, and an object made from it once in each of them.

    For values whose size has a bound: a tokenizer file, one number per id of its vocabulary, a model of fixed size.
    """

    def __init__(self, spark: SparkSession, name: str, value, make=lambda v: v):
        self.name, self.version, self.make = name, uuid.uuid4().hex, make
        self.handle = spark.sparkContext.broadcast(value)

    def get(self):
        return kept_in_worker(self.name, self.version, lambda: self.make(self.handle.value))
