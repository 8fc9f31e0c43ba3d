"""Importance resampling towards a target distribution: hashed word runs, CRCs of all features of a length at once."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Shared, staged

RUNS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 5
SEED = 42

SLICE = 1 << 21
MATRIX_LENGTH = 512
MATRIX_CELLS = 1 << 24

# A-Z become a-z, other ASCII but digits and small letters a blank, bytes of longer characters stay
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def crc_table() -> np.ndarray:
    """What each last byte adds to a CRC-32, by shifting out its bits under the reflected polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


CRC = crc_table()


def crcs(text: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches of ``text``.

    Stretches of one length form a matrix of bytes with a row each, and all their CRCs advance column by column. A
    length beyond MATRIX_LENGTH is rare, so its matrix would be a few rows of many columns: those go one by one.
    """
    data, out = np.frombuffer(text, dtype=np.uint8), np.zeros(len(start), dtype=np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, first[1:])):
        if size > MATRIX_LENGTH:
            out[rows] = [zlib.crc32(text[a:a + size]) for a in start[rows].tolist()]
            continue
        for low in range(0, len(rows), MATRIX_CELLS // size):
            part = rows[low:low + MATRIX_CELLS // size]
            matrix = data[start[part] + np.arange(size)[:, None]]  # a column of the matrix in a row of memory
            crc = np.full(len(part), 0xFFFFFFFF, dtype=np.uint32)
            for column in matrix:
                crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[part] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def slices(texts, runs: int):
    """Lists of (owner, words, carried): the words of whole texts, about SLICE bytes in a list.

    A longer text continues in the next list, which begins with its last runs - 1 words, ``carried`` over: the runs
    that end in them were counted before.
    """
    out, size = [], 0
    for owner, text in enumerate(texts):
        line = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
        at, carried = 0, []
        while at < len(line):
            end = len(line)
            if end - at > SLICE:
                end = line.find(b" ", at + SLICE)
                end = len(line) if end < 0 else end
            words = line[at:end].split()
            if words:
                out.append((owner, carried + words, len(carried)))
                carried = (carried + words)[1 - runs:] if runs > 1 else []
                size += end - at
            at = end
            if size >= SLICE:
                yield out
                out, size = [], 0
    if out:
        yield out


def features(part: list, runs: int, buckets: int):
    """Per run length: (owners, buckets) of the runs of words that end in a slice, repeats included.

    Each distinct run is hashed once and its bucket scattered back to where it occurs. Runs are told apart by numbers
    that stand for exactly their words, not by hashes.
    """
    lists = [w for _, w, _ in part]
    counts = np.array([len(w) for w in lists])
    words = [w for own in lists for w in own]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat([o for o, _, _ in part], counts)
    fresh = place >= np.repeat([c for _, _, c in part], counts)
    own = ids  # of the run that ends at each word; valid from place runs - 1 on
    for k in range(1, runs + 1):
        whole = np.flatnonzero(place >= k - 1)
        if k > 1:
            own = np.where(place >= k - 1, np.concatenate([[0], own[:-1]]) * len(number) + ids, -1)
        _, first, back = np.unique(own[whole], return_index=True, return_inverse=True)
        end = whole[first]
        begin = starts[end - k + 1]
        bucket = (crcs(text, begin, ends[end] - begin) % np.uint32(buckets)).astype(np.int64)
        own = np.full(len(words), -1)
        own[whole] = back
        new = fresh[whole]
        yield owner[whole][new], bucket[back[new]]


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds: a task sends a row a bucket, the driver gets one a bucket."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for part in slices(pdf.iloc[:, 0], runs):
                for _, own in features(part, runs, buckets):
                    total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    own = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in own.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) per bucket: p from the target's counts and q from the source's, each count plus one."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n))))
        for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", runs: int = RUNS) -> DataFrame:
    """(doc_id, w struct<n_words, n_features, weight>): the sum of gains over each text's features."""
    shared = Shared(docs.sparkSession, "gains", gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(column: pd.Series) -> pd.DataFrame:
        table, n = shared.get(), len(column)
        counts, weight = np.zeros((runs, n), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for part in slices(column.fillna(""), runs):
            for k, (owner, bucket) in enumerate(features(part, runs, len(table))):
                counts[k] += np.bincount(owner, minlength=n)
                np.add.at(weight, owner, table[bucket])
        return pd.DataFrame({"n_words": counts[0], "n_features": counts.sum(0), "weight": weight})

    return docs.select("doc_id", weigh(F.col(f"`{text}`")).alias("w"))


def noise(seed: int) -> Column:
    """floor(1000 g), g a Gumbel number made from the hash of the row's doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, runs: int = RUNS,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) against the texts of ``target``: doc_id, n_words, n_features, weight, score, rank.

    A document's weight says how much likelier its features are in the target than in all documents; Gumbel noise makes
    the highest scores a draw without replacement by these weights. Of the documents with ``least_words`` words or
    more, ``share`` percent are drawn, ties going to the smaller doc_id; ``rank`` is null for the others.

    Texts are read twice, for the counts and for the weights, and never shuffled; what moves are five numbers a
    document. Ranks come from a range-partitioned sort and the partitions' sizes, so no task holds them all, and rows
    that agree in score and doc_id are spread by a number of their own.

    A null or empty text has no words, weight 0 and no chance to be drawn. Long texts are read whole, in slices.
    Repeated rows are drawn each for itself, with the same score. A null doc_id is hashed as an empty one and comes
    last among equal scores. Other columns are not read. Empty tables: without documents the result is empty, without
    target all target counts are zero.
    """
    gain = gains(bucket_counts(docs, "text", runs, buckets), bucket_counts(target, "text", runs, buckets))
    scored = staged(
        weighed(docs.select("doc_id", "text"), gain, "text", runs).select("doc_id", "w.*")
        .withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    order = [F.col("score").desc(), F.asc_nulls_last("doc_id"), F.col("row")]
    able = F.col("n_words") >= least_words
    # the id counts rows within a partition from a multiple of 2^33 on
    ordered = staged(
        scored.where(able).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "parts")  # a row a partition
    drawn = share * (parts.agg(F.sum("n")).first()[0] or 0) // 100
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("at") - F.shiftleft("part", 33) + 1
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ordered.withColumn("part", part).join(F.broadcast(bases), "part").select(
        *columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(scored.where(~able).select(*columns, F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all their columns kept; rows that share a doc_id stand or fall together."""
    drawn = resampled(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")


def resampled_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
