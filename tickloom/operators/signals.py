"""News, corporate events and the signal per instrument."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickloom.functions import text as tx
from tickloom.functions.columns import clip
from tickloom.functions.symbols import strip_contract
from tickloom.operators.ranks import value_ranks
from tickloom.session import stage

CHARS = 1 << 16
MOST_BITS = 1 << 24
PROBES = 4
# odd factors that mix bits, the base of the powers and its inverse modulo 2^64
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1342543DE82EF95, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F], dtype=np.uint64)
BASE = np.uint64(0xE7037ED1A0B428DB)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
# Confidence of an aggregated signal, and the suitability of a symbol that has not been scored.
CONFIDENCE, SUITABILITY = 0.9, 0.5


# ---- news ---------------------------------------------------------------------

def normalise(raw: DataFrame) -> DataFrame:
    """Clean text, stable id and parsed time of raw items."""
    d = raw.withColumns({"headline": tx.strip_html(F.col("headline")), "published_at": tx.parse_date(F.col("published"))})
    return d.withColumn("id", tx.news_id(F.col("source"), F.col("headline")))


class Filter:
    """A set of strings as bits: looks for pieces of texts that may be in it. False hits happen, misses do not.

    A piece's hash is a difference of running sums of powers modulo 2^64, so all pieces of one length of many texts
    cost a few array operations, whatever the number of strings. Strings of n characters are told by their first p, the
    largest power of two up to n: all places are tested for a beginning of p, and for n only those that have one.
    """

    def __init__(self, bits: int, lengths: list[int], words: dict[int, int] | None = None):
        self.shift, self.lengths = 64 - (bits.bit_length() - 1), lengths
        packed = np.zeros(bits // 64, dtype="<i8")
        for at, word in (words or {}).items():
            packed[at] = word
        self.table = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
        self.known = [np.empty(0, dtype=np.uint64)] * 2

    def slots(self, h: np.ndarray, probe: int) -> np.ndarray:
        return (h ^ h >> np.uint64(32)) * ODD[probe] >> np.uint64(self.shift)

    def sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        codes = (codes + np.uint64(1)) * ODD[-1]
        codes = (codes ^ codes >> np.uint64(29)) * ODD[-2]
        up, down = self.powers(len(codes))
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * up)]), down

    def powers(self, n: int) -> list[np.ndarray]:
        """The first ``n`` powers of BASE and of its inverse."""
        if n > len(self.known[0]):
            self.known = [np.cumprod(np.full(2 * n, x)) * back for x, back in ((BASE, BACK), (BACK, BASE))]
        return [x[:n] for x in self.known]

    def marks(self, strings: list[str]) -> pd.DataFrame:
        """(w, b): 64-bit words to be put together by OR. A beginning's hash is turned over, so it is no string's."""
        sums = [self.sums(x)[0] for x in strings]
        h = np.array([s[-1] for s in sums] + [~s[_beginning(len(s) - 1)] for s in sums], dtype=np.uint64)
        slots = np.unique(np.concatenate([self.slots(h, k) for k in range(PROBES)]))
        bits = np.left_shift(np.uint64(1), slots & np.uint64(63)).view(np.int64)
        return pd.DataFrame({"w": (slots >> np.uint64(6)).astype(np.int32), "b": bits})

    def pieces(self, text: str):
        """(position, length) of the pieces that may be in the set."""
        sums, down = self.sums(text)
        p, begun = 0, None
        for n in self.lengths:
            if n > len(text):
                return
            if p != _beginning(n):
                p = _beginning(n)
                begun = self.passed(~((sums[p:] - sums[:-p]) * down[: len(text) - p + 1]))
            begun = begun[: np.searchsorted(begun, len(text) - n, side="right")]
            at = begun[self.passed((sums[begun + n] - sums[begun]) * down[begun])]
            yield from ((i, n) for i in at.tolist())

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes whose bits are all set."""
        at = np.flatnonzero(self.table[self.slots(h, 0)])
        for k in range(1, PROBES):
            at = at[self.table[self.slots(h[at], k)]]
        return at

    def search(self, texts) -> list[list[str]]:
        """The distinct pieces of each text that may be in the set. Texts are taken some CHARS characters at a time."""
        found = [set() for _ in texts]
        for group in _chunks(texts, self.lengths[-1]):
            text = "".join([t for _, t in group])
            ends = np.cumsum([len(t) for _, t in group])
            for i, n in self.pieces(text):
                k = int(np.searchsorted(ends, i, side="right"))
                if i + n <= ends[k]:
                    found[group[k][0]].add(text[i:i + n])
        return [list(f) for f in found]


def _beginning(n: int) -> int:
    return 1 << n.bit_length() - 1


def _chunks(texts, most: int):
    """Lists of (row, text) of about CHARS characters; long texts are cut into parts that overlap by ``most`` - 1."""
    out, size = [], 0
    for row, t in enumerate(texts):
        for start in range(0, max(len(t or "") - most + 1, 1 if t else 0), CHARS):
            out.append((row, t[start:start + CHARS + most - 1]))
            size += len(out[-1][1])
            if size >= CHARS:
                yield out
                out, size = [], 0
    if out:
        yield out


def contained_symbols(items: DataFrame, universe: DataFrame, key: str, text: str) -> DataFrame:
    """(key, symbol), without repeats, for each symbol that occurs in the upper-cased text.

    All pieces of the symbols' lengths are tested against one set of bits of the symbols, at most MOST_BITS of them,
    whatever the number of symbols; it is built by a map-side OR in one pass. The few pieces that pass are joined with
    the symbols by equality, so false hits go. The work per character grows with the number of different lengths.
    """
    u = stage(universe.select("symbol").where(F.length("symbol") > 0).distinct(), "symbols")
    count, *lengths = u.agg(F.count(F.lit(1)), F.array_sort(F.collect_set(F.length("symbol")))).first()
    if not count:
        return items.select(key, F.lit(None).cast("string").alias("symbol")).where(F.lit(False))
    bits, lengths = min(MOST_BITS, max(64, 1 << (256 * count - 1).bit_length())), lengths[0]

    def marks(batches):
        empty = Filter(bits, lengths)
        for pdf in batches:
            if len(pdf):
                yield empty.marks(pdf.symbol.tolist())

    words = u.mapInPandas(marks, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    shared = items.sparkSession.sparkContext.broadcast({r.w: r.b for r in words})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = Filter(bits, lengths, shared.value)
        for batch in batches:
            found = have.search(batch.column(1).to_pylist())
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([s for f in found for s in f], pa.string())], names=[key, "symbol"])

    # rows, not arrays to explode: the filter that the optimiser infers from an explode would search every text a second time
    pieces = items.select(key, F.upper(text)).mapInArrow(
        search, StructType([items.schema[key], StructField("symbol", StringType())]))
    return pieces.join(u, "symbol", "left_semi").select(key, "symbol").distinct()


def extract_symbols(items: DataFrame, universe: DataFrame, key: str = "id", text: str = "headline") -> DataFrame:
    """(key, symbol): known symbols in the text and exchange tags, without repeats."""
    tags = items.select(key, F.explode(tx.exchange_tags(F.col(text))).alias("symbol"))
    return contained_symbols(items, universe, key, text).unionByName(tags).distinct()


def tag_symbols(items: DataFrame, universe: DataFrame, key: str = "id", text: str = "headline") -> DataFrame:
    """Adds ``symbols``, sorted. An item mentions at most the universe plus its own tags.

    What is found is staged, not the items with it, so texts move only where they are read later on.
    """
    s = extract_symbols(items, universe, key, text).groupBy(key).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    s = stage(s, "tags")
    return items.join(s, key, "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def merge_feeds(feeds: list[DataFrame], tiebreak: list[str], history: DataFrame | None = None) -> DataFrame:
    """All feeds, one row per id (the first by ``tiebreak``), without ids already stored."""
    d = feeds[0]
    for f in feeds[1:]:
        d = d.unionByName(f, allowMissingColumns=True)
    if history is not None:
        d = d.join(history.select("id"), "id", "left_anti")
    rest = [c for c in d.columns if c != "id"]
    best = d.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*tiebreak)).alias("_r"))
    return best.select("id", "_r.*")


def relevant(items: DataFrame, universe: DataFrame) -> DataFrame:
    """Items that mention a known symbol or a market-wide word. Needs ``symbols``."""
    def named(upper):
        macro = F.lit(False)
        for w in tx.MACRO_WORDS:
            macro = macro | upper.contains(w)
        return macro

    # a text becomes upper case once, and before the join, so it need not move
    macro = F.exists(F.array(F.upper("headline")), named).alias("_macro")
    known = items.select("id", F.explode("symbols").alias("symbol")).join(
        universe.select("symbol"), "symbol", "left_semi").select("id").distinct().withColumn("_hit", F.lit(True))
    d = items.select("*", macro).join(known, "id", "left")
    return d.where(F.coalesce("_hit", F.lit(False)) | F.col("_macro")).drop("_hit", "_macro")


def priority_batch(items: DataFrame, n: int = 10) -> DataFrame:
    """The next items to score: exchange filings first, then oldest."""
    rank = F.when(F.col("source") == "NSE", 0).when(F.col("source") == "BSE", 1).otherwise(2)
    return items.where(~F.coalesce("scored", F.lit(False))).withColumn("priority", rank).orderBy(
        "priority", "published_at", "id").limit(n)


def clamp_scores(items: DataFrame) -> DataFrame:
    """Scored fields forced into their ranges; an unknown action becomes NORMAL."""
    def num(c, default, lo, hi):
        return clip(F.coalesce(F.col(c).cast("double"), F.lit(default)), lo, hi)

    return items.withColumns({
        "sentiment": num("sentiment", 0.0, -1.0, 1.0), "uncertainty": num("uncertainty", 0.0, 0.0, 1.0),
        "widen_factor": num("widen_factor", 1.0, 1.0, 5.0),
        "pause_minutes": num("pause_minutes", 0.0, 0.0, 240.0).cast("int"),
        "mm_action": F.when(F.col("mm_action").isin("PAUSE", "WIDEN", "NORMAL"), F.col("mm_action")).otherwise("NORMAL")})


def news_by_instrument(items: DataFrame, instruments: DataFrame) -> DataFrame:
    """(contract, id): the item is tagged with the contract's underlying, by text or by the scorer."""
    tags = items.select("id", F.explode(F.array_union(
        "symbols", F.coalesce(F.col("llm_symbols"), F.array().cast("array<string>")))).alias("equity")).distinct()
    master = instruments.select(F.col("symbol").alias("contract")).distinct().withColumn("equity", strip_contract("contract"))
    return tags.join(master, "equity").select("contract", "equity", "id").distinct()


def worst_news(items: DataFrame, links: DataFrame) -> DataFrame:
    """The scored item of highest uncertainty per contract (smallest id on a tie)."""
    cols = ["uncertainty", "mm_action", "widen_factor", "pause_minutes", "sentiment", "informed_flow_risk", "event_type", "id"]
    d = links.join(items.where("scored").select(*cols), "id")
    best = d.groupBy("contract").agg(F.min_by(F.struct(*cols), F.struct(-F.col("uncertainty"), F.col("id"))).alias("_w"))
    return best.select("contract", "_w.*")


def news_actions(items: DataFrame) -> DataFrame:
    """Worst action and largest factor per mentioned symbol, from items that ask for one."""
    d = items.where(F.col("scored") & (F.col("mm_action") != "NORMAL")).select(
        F.explode("symbols").alias("symbol"), "mm_action", "widen_factor")
    return d.groupBy("symbol").agg(
        F.max_by("mm_action", tx.rank_in(F.col("mm_action"), tx.ACTIONS)).alias("worst_action"),
        F.max("widen_factor").alias("max_factor"), F.count(F.lit(1)).alias("n_items"))


def banned(symbols: DataFrame, ban_list: DataFrame) -> DataFrame:
    return symbols.withColumn("_e", strip_contract("symbol")).join(
        ban_list.select(F.col("symbol").alias("_e")), "_e", "left_semi").drop("_e")


# ---- events --------------------------------------------------------------------

def merge_events(feeds: list[DataFrame]) -> DataFrame:
    """One row per (symbol, date, type); the first feed of the list wins, then the smallest description."""
    d = None
    for i, f in enumerate(feeds):
        f = f.withColumn("_f", F.lit(i))
        d = f if d is None else d.unionByName(f, allowMissingColumns=True)
    d = d.where("symbol <> ''").withColumn("event_type", tx.event_class(F.col("description")))
    best = d.groupBy("symbol", "event_date", "event_type").agg(
        F.min_by(F.struct("description", "source"), F.struct("_f", "description")).alias("_r"))
    return best.select("symbol", "event_date", "event_type", "_r.*")


def upcoming(events: DataFrame, instruments: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Events of each contract's underlying within the next days."""
    left = F.datediff(F.col("event_date"), F.lit(as_of).cast("date"))
    ev = events.withColumn("days_until", left).where(F.col("days_until").between(0, days))
    master = instruments.select(F.col("symbol").alias("contract")).distinct().where(~F.col("contract").contains("USDINR"))
    master = master.withColumn("symbol", strip_contract("contract"))
    return ev.join(master, "symbol")


def event_signals(events: DataFrame, instruments: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The most important coming event of every contract and what it asks for; NORMAL without one."""
    up = upcoming(events, instruments, as_of, days)
    cols = ["event_type", "event_date", "days_until", "description"]
    best = up.groupBy("contract").agg(F.min_by(F.struct(*cols), F.struct(
        tx.rank_in(F.col("event_type"), tx.EVENT_RANK), "days_until", "description")).alias("_e"))
    best = best.select("contract", "_e.*").withColumn("_i", tx.event_impact(F.col("event_type"), F.col("days_until")))
    d = instruments.select(F.col("symbol").alias("contract")).distinct().join(best, "contract", "left")
    return d.select(
        "contract", "event_type", "event_date", "days_until", "description",
        F.coalesce("_i.action", F.lit("NORMAL")).alias("action"), F.coalesce("_i.factor", F.lit(1.0)).alias("factor"),
        F.coalesce("_i.pause_minutes", F.lit(0)).alias("pause_minutes"), F.col("event_type").isNotNull().alias("has_event"))


# ---- aggregation ------------------------------------------------------------------

def _pause(action: Column, minutes: Column, as_of: Column) -> Column:
    return F.when((action == "PAUSE") & (minutes > 0), as_of + F.make_dt_interval(mins=minutes.cast("int")))


def components(events: DataFrame, news: DataFrame, as_of: str, min_uncertainty: float = 0.4) -> DataFrame:
    """One row per contract and source. A WIDEN from uncertain news below the threshold is dropped."""
    now = F.lit(as_of).cast("timestamp")
    no_date = F.lit(None).cast("date").alias("event_date")
    ev = events.select(
        F.col("contract").alias("symbol"), F.lit("EVENTS").alias("source"), "action", "factor",
        F.col("event_date").cast("date").alias("event_date") if "event_date" in events.columns else no_date,
        _pause(F.col("action"), F.col("pause_minutes"), now).alias("pause_until"), "event_type", "days_until", "has_event",
        F.concat(F.col("event_type"), F.lit(" in "), F.col("days_until").cast("string"), F.lit(" day(s)")).alias("reason"),
        F.lit(None).cast("double").alias("sentiment"), F.lit(None).cast("double").alias("uncertainty"),
        F.lit(None).cast("string").alias("flow_risk"))
    weak = (F.col("mm_action") == "WIDEN") & (F.col("uncertainty") < min_uncertainty)
    act = F.when(weak, "NORMAL").otherwise(F.col("mm_action"))
    nw = news.select(
        F.col("contract").alias("symbol"), F.lit("NEWS").alias("source"), act.alias("action"),
        F.when(weak, 1.0).otherwise(F.col("widen_factor")).alias("factor"), no_date,
        _pause(act, F.col("pause_minutes"), now).alias("pause_until"), F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("int").alias("days_until"), F.lit(False).alias("has_event"),
        F.concat(F.lit("news "), F.col("event_type")).alias("reason"), "sentiment", "uncertainty",
        F.col("informed_flow_risk").alias("flow_risk"))
    return ev.unionByName(nw)


def aggregate_signals(parts: DataFrame, symbols: DataFrame, as_of: str, ttl_minutes: int = 15, cap: float = 4.0) -> DataFrame:
    """One signal per symbol: most cautious action, product of factors up to ``cap``, earliest pause."""
    live = F.col("action") != "NORMAL"
    ev, nw = F.col("source") == "EVENTS", F.col("source") == "NEWS"
    g = parts.groupBy("symbol").agg(
        F.max(tx.rank_in(F.col("action"), tx.ACTIONS)).alias("_a"),
        F.sum(F.when(F.col("factor") > 1, F.log("factor")).otherwise(0.0)).alias("_lf"),
        F.min("pause_until").alias("pause_until"), F.max("pause_until").alias("pause_until_latest"),
        F.max(F.when(ev & live, F.concat(F.lit("[EVENTS] "), F.col("reason")))).alias("_r1"),
        F.max(F.when(nw & live, F.concat(F.lit("[NEWS] "), F.col("reason")))).alias("_r2"),
        F.max(F.when(ev & live, F.when(F.col("event_type") == "EARNINGS", "EARNINGS").otherwise("CORPORATE"))).alias("_s1"),
        F.max(F.when(nw & live, F.lit("NEWS"))).alias("_s2"),
        F.max(F.when(ev, F.col("action"))).alias("_ea"), F.max(F.when(ev, F.col("event_type"))).alias("event_type"),
        F.max(F.when(ev, F.col("event_date"))).alias("event_date"),
        F.max(F.when(ev, F.col("days_until"))).alias("days_to_event"), F.max("has_event").alias("has_upcoming_event"),
        F.max("sentiment").alias("news_sentiment"), F.max("uncertainty").alias("news_uncertainty"),
        F.max(nw & live).alias("active_news"), F.max("flow_risk").alias("_risk"))
    now = F.lit(as_of).cast("timestamp")
    d = symbols.select("symbol").distinct().join(g, "symbol", "left")
    risk = F.coalesce("_risk", F.lit("LOW"))
    event = F.coalesce("has_upcoming_event", F.lit(False))
    names = F.array(*[F.lit(a) for a in tx.ACTIONS])
    return d.select(
        "symbol", now.alias("generated_at"), (now + F.make_dt_interval(mins=F.lit(ttl_minutes))).alias("expires_at"),
        F.get(names, F.coalesce("_a", F.lit(0))).alias("mm_action"),
        F.round(F.least(F.exp(F.coalesce("_lf", F.lit(0.0))), F.lit(cap)), 2).alias("widen_factor"),
        "pause_until", "pause_until_latest",
        F.when(F.col("_r1").isNull() & F.col("_r2").isNull(), "All clear").otherwise(
            F.concat_ws(" | ", "_r1", "_r2")).alias("reason"),
        F.coalesce("_s2", "_s1", F.lit("DEFAULT")).alias("source"),
        F.coalesce("news_sentiment", F.lit(0.0)).alias("news_sentiment"),
        F.coalesce("news_uncertainty", F.lit(0.0)).alias("news_uncertainty"),
        F.coalesce("active_news", F.lit(False)).alias("active_news"), event.alias("has_upcoming_event"),
        "event_type", "event_date", "days_to_event",
        F.lit(CONFIDENCE).alias("confidence"), F.lit(SUITABILITY).alias("mm_suitability"),
        F.when(event & F.col("_ea").isin("PAUSE", "AVOID"), "HIGH")
        .when(event & (F.col("_ea") == "WIDEN") & (risk == "LOW"), "MEDIUM").otherwise(risk).alias("asymmetry_risk"))


def current_signals(history: DataFrame, symbols: DataFrame, as_of: str) -> DataFrame:
    """Latest signal per symbol while it lives, else the neutral default."""
    now = F.lit(as_of).cast("timestamp")
    cols = ["generated_at", "expires_at", "mm_action", "widen_factor"]
    last = history.where(F.col("generated_at") <= now).groupBy("symbol").agg(
        F.max_by(F.struct(*cols), "generated_at").alias("_s")).select("symbol", "_s.*").where(F.col("expires_at") >= now)
    d = symbols.select("symbol").distinct().join(last, "symbol", "left")
    return d.withColumns({
        "is_default": F.col("mm_action").isNull(), "mm_action": F.coalesce("mm_action", F.lit("NORMAL")),
        "widen_factor": F.coalesce("widen_factor", F.lit(1.0))})


def effective_widening(signals: DataFrame, as_of: str) -> DataFrame:
    """Paused and stale flags and the factor a quoter should use."""
    now = F.lit(as_of).cast("timestamp")
    act, days = F.col("mm_action"), F.col("days_to_event")
    paused = F.when(~act.isin("PAUSE", "AVOID"), False).when(
        F.col("pause_until").isNull(), act == "AVOID").otherwise(now < F.col("pause_until"))
    near = F.when(days == 0, 3.0).when(days == 1, 2.0).when(days <= 3, 1.5).otherwise(0.0)
    risk = F.when(F.col("asymmetry_risk") == "HIGH", 2.0).when(F.col("asymmetry_risk") == "MEDIUM", 1.2).otherwise(0.0)
    return signals.withColumns({"is_paused": paused, "is_stale": now > F.col("expires_at")}).withColumn(
        "effective_factor", F.when(F.col("is_paused"), 999.0).otherwise(
            F.round(F.greatest(F.col("widen_factor"), near, risk), 2)))


def rank_universe(scores: DataFrame, tier1: float = 0.7, tier2: float = 0.4) -> DataFrame:
    """Rank by suitability, equal scores sharing the best rank, and tier. ``scores``: symbol, mm_suitability."""
    r = value_ranks(scores, [], "mm_suitability").select(
        "mm_suitability", (F.col("total") - F.col("below") - F.col("n") + 1).alias("rank"))
    s = F.col("mm_suitability")
    return scores.join(r, "mm_suitability").withColumn(
        "recommendation", F.when(s >= tier1, "TIER1").when(s >= tier2, "TIER2").otherwise("AVOID"))
