"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import place

# fixed values: the patterns of the base kinds, the group and the least size that count
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
SAMPLE_ROWS = 1_000
RANDOM_STRINGS = 2_000
LEAST_RATIO = 12.0
SIDE = 128

SPAN = "array<struct<start:int,end:int,word:string>>"


def located(text: Column, pattern: str, group: Column | None = None, least: int = 0) -> Column:
    """(start, end, word) of all leftmost non-overlapping matches, in code points, end exclusive.

    What the pattern splits off gives the gaps between the matches, so both arrays are walked once. With ``group``,
    the matches' captured parts, only those of ``least`` characters or more stay.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(found, found if group is None else group, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("n")))
    steps = F.zip_with(gaps, parts, lambda g, p: F.struct(F.length(g).alias("gap"), p["m"].alias("m"), p["n"].alias("n")))
    none = F.array().cast(SPAN)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        here = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("word")))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(
            end.alias("at"), F.when(x["n"] >= least, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out")))

    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def codes(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.ascii(c))


def transitions(word: Column) -> Column:
    """Numbers of the character pairs of an ASCII word: first * 128 + second."""
    c = codes(word)
    n = F.length(word)
    return F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), lambda a, b: a * SIDE + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs from (word, random): random strings over ordinary identifiers.

    Both are first-order chains with add-one smoothing over the characters seen. The counts of at most 128 * 128 pairs
    a model come to the driver, whatever the number of samples. Empty samples give ratios of 0.
    """
    pairs = samples.where(F.length("word") > 1).select(F.col("random").cast("int").alias("r"), F.explode(transitions(F.col("word"))).alias("p"))
    counts = {(r.r, r.p): r.n for r in pairs.groupBy("r", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = len({c for _, p in counts for c in divmod(p, SIDE)}) or 1
    total: dict[tuple[int, int], int] = {}
    for (r, p), n in counts.items():
        total[r, p // SIDE] = total.get((r, p // SIDE), 0) + n

    def log(r, p):
        return math.log((counts.get((r, p), 0) + 1) / (total.get((r, p // SIDE), 0) + size))

    return [round(log(1, p) - log(0, p), 4) for p in range(SIDE * SIDE)]


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS, strings: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled (word, random): digests written in base 64, hexadecimal and capitals, and the words of some documents.

    The documents are the ``rows`` ones whose id and text have the smallest hash; their words that contain a digit or an
    access key are not ordinary and are left out. Candidates are those in the share of all hashes that is to hold four
    times ``rows``, so no task orders more than some thousand of them.
    """
    seed = F.sha2(F.col("id").cast("string"), 256)
    raw = F.unhex(seed)
    made = docs.sparkSession.range(strings).select(F.explode(F.array(
        F.base64(raw), F.substring(seed, 1, 40), F.upper(F.substring(F.regexp_replace(F.base64(raw), "[+/=]", "7"), 1, 20)),
        F.regexp_replace(F.base64(raw), "[+/=]", ""))).alias("word"), F.lit(True).alias("random"))
    likely = docs.withColumn("_h", place("doc_id", "text")).where(F.col("_h") < 4 * rows / max(docs.count(), 1))
    few = likely.where(F.col("text").isNotNull()).orderBy("_h", F.xxhash64("text")).limit(rows)
    words = few.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("word"))
    plain = words.where(~F.rlike("word", F.lit("[0-9]")) & ~F.rlike("word", F.lit(ACCESS))).select("word", F.lit(False).alias("random"))
    return made.union(plain)


def scan(df: DataFrame, ratios: list[float], text: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """Adds the spans assign, access, hex and random, each array<struct<start, end, word>>.

    A candidate run of 20 or more identifier characters is random if the sum of its pairs' log-likelihood ratios is
    ``least`` or more. Null texts count as empty; columns with the names of the results are replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # a literal of 128 * 128 numbers
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def ratio(word):
        return F.aggregate(transitions(word), F.lit(0.0), lambda s, p: s + F.get(table, p))

    value = F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(1))
    return df.withColumns({
        "assign": located(whole, ASSIGN, value, 12),
        "access": F.filter(located(whole, ACCESS), lambda s: F.length(s["word"]) >= 18),
        # runs are maximal, so those of 16 or more are the long ones among all runs
        "hex": located(whole, HEX[:-1] + "{16,}"),
        "random": F.filter(located(whole, CANDIDATE), lambda s: ratio(s["word"]) >= least),
    })


def spans_text(kinds: list[str]) -> Column:
    """kind:start:end of the named columns' spans, by start, then kind as listed; comma-joined."""

    def tagged(order: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned_documents(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), train(samples(docs)))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")],
        F.sha2(spans_text(["assign", "access", "hex"]), 256).alias("base_sha256"),
        spans_text(["assign", "access", "hex", "random"]).alias("spans"))
