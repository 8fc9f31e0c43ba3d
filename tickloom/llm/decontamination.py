"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free, own_columns, row_key, staged

WINDOW = 13
GRAM = 5

# fixed value: the words of a text
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def runs(w: Column, k: int) -> Column:
    """Hashes of all runs of k words of an array; none if it has fewer."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<bigint>"))


def winnowed(df: DataFrame, w: str, window: int, gram: int) -> DataFrame:
    """Adds ``marks``: the distinct least run hashes of all windows of the word array ``w``.

    The least of nine consecutive hashes comes by doubling: four passes over the array instead of nine.
    """
    def halved(step: int) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size("marks") - 1 - step),
                            lambda i: F.least(F.get("marks", i), F.get("marks", i + step)))
        return F.when(F.size("marks") > step, pairs).otherwise(F.array().cast("array<bigint>"))

    df = df.withColumn("marks", runs(F.col(w), gram))
    width, length = window - gram + 1, 1
    while length < width:
        step = min(length, width - length)
        df = df.withColumn("marks", halved(step))
        length += step
    return df.withColumn("marks", F.array_distinct("marks"))


def windows_of(w: Column, starts: Column, size: int) -> Column:
    """(at, words) of the windows that begin at the given positions."""
    return F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice(w, i + 1, size), " ").alias("words")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, words): the windows of every item; an item of fewer words, but not none, is one window."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(0), F.size("w") - size)
    return listed.select("item_id", size.alias("size"), "w", F.explode(F.transform(
        starts, lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("words")).select("item_id", "size", "words")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text) as doc_id, node, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of ``docs``.

    Winnowing: of the run hashes in each window of 13 words the least is kept, for documents and items alike, so equal
    windows keep equal hashes and every shared span of 13 words has one in common. Kept hashes are joined; only
    documents with a match are read again, and each match is extended to all windows around it, which are compared
    with the items' windows word by word. Items of fewer than 13 words are windows of their own size, found among all
    runs of that size (at most twelve sizes, read from the items beforehand).

    The items' tables are joined as the planner sees fit; nothing of the documents reaches the driver. Documents are
    named by a hash of their text, so copies are looked up once. A null text has no words. Repeated rows each get
    their result, a null item_id hits words but is not listed, an item listed twice counts once, and empty tables give
    no hits.
    """
    named = docs.select("doc_id", "text").withColumn("node", row_key("text"))
    marked = winnowed(named.select("node", words(F.col("text")).alias("w")), "w", window, gram)
    # neither a filter nor an inner explode stands on computed arrays here: the optimiser would push the filter, or the
    # one that it infers from the explode, below every step and copy the expression each time
    marked = staged(marked.select("node", "marks"), "marks")
    known = item_windows(items, window)
    kept = winnowed(items.select(words(F.col("text")).alias("w")), "w", window, gram)
    kept = kept.select(F.explode_outer("marks").alias("mark")).distinct()
    matched = staged(
        marked.select("node", F.explode("marks").alias("mark")).join(kept, "mark")
        .groupBy("node").agg(F.collect_set("mark").alias("hits")), "matches")

    texts = named.select("node", "text").join(matched, "node")
    texts = texts.select("node", words(F.col("text")).alias("w"), "hits")
    texts = texts.withColumn("runs", runs(F.col("w"), gram))
    around = F.array_distinct(F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda i: F.array_contains("hits", F.get("runs", i))),
        lambda i: F.sequence(F.greatest(F.lit(0), i - (window - gram)), F.least(i, F.size("w") - window)))))
    spans = texts.withColumn("starts", around).select(
        "node", F.explode_outer(windows_of(F.col("w"), F.col("starts"), window)).alias("x")).select(
        "node", "x.at", F.lit(window).alias("size"), "x.words")

    # sizes below the window that items have: at most window - 1 numbers
    for size in sorted(r.size for r in known.where(F.col("size") < window).select("size").distinct().collect()):
        every = named.select("node", words(F.col("text")).alias("w")).where(F.size("w") >= size)
        spans = spans.union(every.select("node", F.explode_outer(windows_of(
            F.col("w"), F.sequence(F.lit(0), F.size("w") - size), size)).alias("x")).select(
            "node", "x.at", F.lit(size).alias("size"), "x.words"))

    found = spans.join(known.distinct(), ["size", "words"]).groupBy("node").agg(
        F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # words covered: what each span adds beyond the farthest end before it
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).alias("n"),
            F.greatest(s["end"], x["at"] + x["size"]).alias("end")))["n"]
    found = staged(found.select("node", covered.cast("long").alias("n_hit"), "items"), "hits")

    counted = named.select("doc_id", "node", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(found, "node", "left").select(
        "doc_id", "node", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, their columns unchanged; null and empty texts are not."""
    name, = free(docs, "n")
    bad = contamination(docs, items).where("contaminated").select(F.col("node").alias(name)).distinct()
    return docs.withColumn(name, row_key("text")).join(bad, name, "left_anti").select(*own_columns(docs))


SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT *, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
span AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM low, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM span JOIN win USING (n, words)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
            string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hit GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""
