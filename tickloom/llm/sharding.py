"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged

CELL_BITS = 20


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Clockwise cells of the virtual nodes and their shards. A node's cells do not depend on the number of shards."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") >> (64 - CELL_BITS), s)
        for s in range(shards) for v in range(vnodes))
    return [c for c, _ in nodes], [s for _, s in nodes]


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """Rows a shard may hold: ``load`` times the mean; at 1 the bounds add up to all rows and differ by one at most."""
    if load == 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(np.ceil(load * rows / shards))] * shards


def placed(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from rank, to rank, shard). Keys first fill their own arc's shard; those over its bound walk clockwise."""
    room, out, over = list(room), [], []
    for arc, n in enumerate(counts):
        take = min(n, room[owners[arc]])
        room[owners[arc]] -= take
        if take:
            out.append((arc, 0, take, owners[arc]))
        if n > take:
            over.append((arc, take, n))
    for arc, low, high in over:
        at = arc
        while low < high:
            at = (at + 1) % len(owners)
            take = min(high - low, room[owners[at]])
            if take:
                room[owners[at]] -= take
                out.append((arc, low, low + take, owners[at]))
                low += take
    return out


def assign_shards(df: DataFrame, key: str, shards: int = 16, vnodes: int = 128, load: float = 1.0) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard) to every row of ``df``.

    The key's hash names one of 2^20 cells of the ring, a cell belongs to the next virtual node clockwise. Only the
    number of rows of each arc (shards * vnodes of them) comes to the driver; it decides which ranks of an arc stay and
    which go on to the next shard with room. Rows get their rank from a sort within a cell and the totals of the cells
    before it, so no task sees more than a millionth of the keys.

    ``load`` bounds a shard at that multiple of the mean; at 1 the shards' rows differ by one at most. A null key hashes
    like a value. Repeated keys are rows of their own; rows that are equal in every column are interchangeable. An empty
    table gives an empty result. Columns named shard or slot in the input are replaced.
    """
    df = df.drop("shard", "slot")
    names = df.columns
    cells, owners = ring(shards, vnodes)
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.xxhash64(F.col(f"`{key}`")).alias("_pos"),
    ).withColumn("_cell", F.shiftrightunsigned("_pos", 64 - CELL_BITS))

    @F.pandas_udf("int")
    def arc_of(cell: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cells, cell.to_numpy()) % len(cells)).astype("int32")

    inner = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sized = staged(
        keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_arc", arc_of("_cell"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))), "cells")
    totals = {r[0]: r[1] for r in sized.groupBy("_arc").agg(F.sum("_n")).collect()}
    counts = [totals.get(a, 0) for a in range(len(cells))]
    room = capacities(sum(counts), shards, load)
    filled, segments = [0] * shards, []
    for arc, low, high, shard in sorted(placed(counts, owners, room)):
        segments.append((arc, low, high, shard, filled[shard] - low))
        filled[shard] += high - low
    pieces = df.sparkSession.createDataFrame(segments, "_arc int, _low long, _high long, shard int, _shift long")
    ranked = keyed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_pos", "_row")) - 1)
    return (
        ranked.join(sized.select("_cell", "_arc", "_before"), "_cell")
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        # at most shards * (vnodes + 1) pieces, whatever the rows
        .join(F.broadcast(pieces.withColumnRenamed("_arc", "_a")),
              (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
        .select("_row.*", "shard", (F.col("_rank") + F.col("_shift")).alias("slot")))


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents over shards with row counts at most one apart; one row per document, without its text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return assign_shards(slim, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a shard is one sorted run only where it fits a task, so rows keep their slot column."""
    sharded.write.partitionBy("shard").parquet(path)
