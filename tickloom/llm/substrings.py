"""Substring deduplication by content-defined phrases and a join of the windows of those left over."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Shared, row_key, staged
from tickloom.llm.hashing import Words, grams, mix

WINDOW = 50
SEED = 13

PHRASES = "pos array<int>, size array<int>, seed array<long>, phrase array<long>"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each run of ``width``, the leftmost of equal ones."""
    n = len(values) - width + 1
    index = np.arange(len(values))
    length = 1
    while length * 2 <= width:
        a, b = index[:-length], index[length:]
        index = np.where(values[a] <= values[b], a, b)
        length *= 2
    if length < width:
        a, b = index[:n], index[width - length: width - length + n]
        index = np.where(values[a] <= values[b], a, b)
    return index[:n]


def phrases(words: np.ndarray, window: int, seed: int):
    """Cuts the windows of a document into phrases: (first window, number of windows, seed hash, phrase hash).

    A window's seed is the least hash of its runs of ``seed`` words, so equal windows have equal seeds wherever they
    stand. Consecutive windows with the same seed occurrence are one phrase; the phrase hash covers all its words.
    """
    if len(words) < window:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),) * 2
    short, whole = grams(words, seed), grams(words, window)
    at = _least(short, window - seed + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, len(at)))
    with np.errstate(over="ignore"):
        # the offset of the seed is part of the phrase, and so is every window
        inside = np.arange(len(at)) - np.repeat(first, size)
        parts = mix(whole + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        phrase = mix(np.add.reduceat(parts, first) + (at[first] - first).astype(np.uint64))
    return first, size, short[at[first]], phrase


def removed_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, node, starts): first words of the windows of each document that also start in a smaller doc_id.

    Documents are cut at content-defined places into phrases of some twenty overlapping windows; the phrases, hashed
    by (seed, phrase) and kept with their smallest doc_id, are the reference blocks. A document is parsed against all
    of them at once by joining its phrases with the index: a phrase that an earlier document has is a factor whatever
    stands around it. Long factors break off inside a phrase, so at factor boundaries, that is in phrases that are not
    in an earlier document but whose seed is in another one, the parse goes on window by window against the windows of
    all phrases with that seed. Every window belongs to exactly one phrase and its seed is its own content, so nothing
    is lost; windows are identified by 128 bits (their hash and their seed).

    Phrases cost a twentieth of the words in rows, windows are only expanded at boundaries, and both are joined by
    hash; a passage in a third of the documents is one index row, found before the join by partial aggregation.
    """
    words = Shared(docs.sparkSession, "words", None, lambda _: Words())

    @F.pandas_udf(PHRASES)
    def cut(column: pd.Series) -> pd.DataFrame:
        out = []
        for t in column:
            first, size, key, phrase = phrases(words.get()(t)[1], window, seed)
            out.append((first.astype(np.int32), size.astype(np.int32), key.view(np.int64), phrase.view(np.int64)))
        return pd.DataFrame(out, columns=["pos", "size", "seed", "phrase"])

    named = docs.select("doc_id", "text", row_key("doc_id", "text").alias("node")).where(
        F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    table = staged(
        # no filter on the phrases: it would be pushed below them and cut every text a second time, in a worker of its own
        named.select("doc_id", "node", cut("text").alias("p")).select(
            "doc_id", "node", F.explode(F.arrays_zip("p.pos", "p.size", "p.seed", "p.phrase")).alias("p"))
        .select("doc_id", "node", "p.*"), "phrases")

    # the index of whole phrases, for seeds that more than one document has
    index = table.groupBy("seed", "phrase").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("size").alias("size"))
    by_seed = index.groupBy("seed").agg(
        F.min("low").alias("a"), F.max("high").alias("b"), F.count(F.lit(1)).alias("kinds")).where("a < b")
    index = staged(index.join(by_seed.select("seed", "kinds"), "seed").select("seed", "phrase", "low", "high", "kinds"),
                   "index")
    parsed = staged(table.join(index, ["seed", "phrase"]).withColumn("whole", F.col("low") < F.col("doc_id"))
                    .where("whole or kinds > 1"), "parsed")
    factors = parsed.where("whole").select(
        "doc_id", "node", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("at"))

    # at the boundaries: the windows of the phrases that are first of their kind, one document for each kind
    edges = parsed.where("not whole and low = doc_id").groupBy("node").agg(
        F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("pos", "size", "seed")).alias("edges"))

    @F.pandas_udf("at array<int>, seed array<long>, hash array<long>")
    def spread(text: pd.Series, edges: pd.Series) -> pd.DataFrame:
        out = []
        for t, e in zip(text, edges):
            whole = grams(words.get()(t)[1], window).view(np.int64)
            at = np.concatenate([np.arange(x["pos"], x["pos"] + x["size"]) for x in e])
            out.append((at.astype(np.int32), np.repeat([x["seed"] for x in e], [x["size"] for x in e]), whole[at]))
        return pd.DataFrame(out, columns=["at", "seed", "hash"])

    windows = staged(
        named.select("node", "text").join(edges, "node").select("doc_id", "node", spread("text", "edges").alias("w"))
        .select("doc_id", "node", F.explode(F.arrays_zip("w.at", "w.seed", "w.hash")).alias("w"))
        .select("doc_id", "node", "w.*"), "windows")
    earliest = windows.groupBy("seed", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    earliest = staged(earliest.where("low < high").select("seed", "hash", "low"), "earliest")
    found = windows.join(earliest, ["seed", "hash"]).where("low < doc_id").select("doc_id", "node", "at")
    return factors.union(found).groupBy("node").agg(F.collect_set("at").alias("starts"))


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, text) as doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a run of ``window`` consecutive words around it also starts in a document with a smaller doc_id, as
    the input has them. Words stand between ASCII white space. Texts that are null have no words; shorter ones than the
    window lose none. A null doc_id is neither smaller nor larger than any other: its document stays whole and counts
    for none. Rows with the same doc_id do not remove each other's words. Empty tables give empty results.
    """
    named = docs.select("doc_id", "text").withColumn("node", row_key("doc_id", "text"))
    words = Shared(docs.sparkSession, "words", None, lambda _: Words())

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, starts):
            own = (t or "").encode("utf-8").split()
            if s is None or not len(s):
                out.append((len(own), 0, b" ".join(own).decode()))
                continue
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(edge, np.asarray(s), 1)
            np.add.at(edge, np.asarray(s) + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            out.append((len(own), int(gone.sum()), b" ".join([w for w, g in zip(own, gone) if not g]).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    spans = removed_spans(docs, window, seed)
    return named.join(spans, "node", "left").select("doc_id", keep("text", "starts").alias("k")).select("doc_id", "k.*")


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
