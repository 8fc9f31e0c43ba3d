"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check of the links."""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Shared, few, free, own_columns, row_key, staged
from tickloom.llm.components import components
from tickloom.llm.hashing import Words, grams, mix, unit

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
TASK_NODES, PART_NODES = 256, 4096
ROUNDS, CHOSEN = 3, 6
BATCH_ROWS = 1000

# Poisson(1): probability of at most 0, 1, 2, ... darts in a region of area one
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int):
    """All darts that hit: (owner, coordinate, rank, name).

    The plane over an element is weight times rank, cut into regions of area one. The element and the region seed a
    Poisson number of darts, so every set that holds the element sees the same darts; those above the element's weight
    or beyond the owner's rank ``limit`` miss. A dart's hash also names the coordinate it may fill.
    """
    layers = np.ceil(weights).astype(np.int64)
    depth = np.ceil(limit).astype(np.int64)[owner]
    cells = layers * depth
    at = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    layer, ring = cell // depth[at], cell % depth[at]
    seed = mix(elements[at] + mix(layer.astype(np.uint64) * np.uint64(0x100000000) + ring.astype(np.uint64)))
    number = np.searchsorted(_POISSON, unit(seed), side="right")
    hit = np.repeat(np.arange(len(at)), number)
    nth = np.arange(len(hit)) - np.repeat(np.cumsum(number) - number, number)
    name = mix(seed[hit] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    rank = ring[hit] + unit(mix(name ^ np.uint64(0xA5A5A5A5)))
    height = layer[hit] + unit(mix(name ^ np.uint64(0x5A5A5A5A)))
    who = owner[at[hit]]
    inside = (height < weights[at[hit]]) & (rank < limit[who])
    name = name[inside]
    return who[inside], (mix(name) % np.uint64(k)).astype(np.int64), rank[inside], name


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k names per (elements, weights): the earliest dart of each coordinate.

    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. About k ln k + 2k darts
    are thrown whatever the size of a set; a set with a coordinate left empty is thrown at again, twice as far. Empty
    sets have a row of zeros.
    """
    out = np.zeros((len(sets), k), dtype=np.uint64)
    todo = np.array([i for i, (e, _) in enumerate(sets) if len(e)], dtype=np.int64)
    throws = k * math.log(k) + 2 * k
    with np.errstate(over="ignore"):
        while len(todo):
            sizes = [len(sets[i][0]) for i in todo]
            elements, weights = (np.concatenate([sets[i][j] for i in todo]) for j in (0, 1))
            owner = np.repeat(np.arange(len(todo)), sizes)
            limit = throws / np.bincount(owner, weights)
            who, coordinate, rank, name = darts(elements, weights, owner, limit, k)
            key = who * k + coordinate
            order = np.lexsort((name, rank, key))
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
            filled = key[first]
            out[todo[filled // k], filled % k] = name[order][first]
            short = np.bincount(filled // k, minlength=len(todo)) < k
            todo, throws = todo[short], throws * 2
    return out


def shingles(text: str, words: Words, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of five words and their weights: 1, or how often each occurs."""
    found, n = np.unique(grams(words(text)[1], SHINGLE), return_counts=True)
    return found, n.astype(np.float64) if counted else np.ones(len(found))


def _groups(texts, most: int = 100_000):
    """Texts taken together until they have about ``most`` characters times ten; one long text is a group."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= 10 * most:
            yield out
            out, size = [], 0
    if out:
        yield out


def banded(df: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """Adds ``bands``, a long for each run of ``rows`` coordinates; empty for a null text or one without words."""
    words = Shared(df.sparkSession, "words", None, lambda _: Words())

    @F.pandas_udf("array<long>")
    def sketch(column: pd.Series) -> pd.Series:
        out = []
        for group in _groups(column.fillna("")):
            sets = [shingles(t, words.get(), counted) for t in group]
            names = signatures(sets, bands * rows)
            with np.errstate(over="ignore"):
                keys = np.zeros((len(group), bands), dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys + names[:, r::rows])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
            out += [b.tolist() if len(e[0]) else [] for e, b in zip(sets, keys.view(np.int64))]
        return pd.Series(out)

    return df.withColumn("bands", sketch(F.col(f"`{text}`")))


def similar(left: list[np.ndarray], right: list[np.ndarray], least: float, columns: int = 20_000) -> np.ndarray:
    """Which sets of two lists (of distinct elements) have a Jaccard similarity of ``least`` or more, as a matrix."""
    whole = [np.concatenate(side) if side else np.empty(0, dtype=np.uint64) for side in (left, right)]
    shared = np.intersect1d(*whole)
    both = np.zeros((len(left), len(right)))

    def incidence(side, all_of, part):
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(part, all_of)
        here = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == all_of)
        out = np.zeros((len(side), len(part)), dtype=np.float32)
        out[row[here], at[here]] = 1
        return out

    for start in range(0, len(shared), columns):
        part = shared[start:start + columns]
        both += incidence(left, whole[0], part) @ incidence(right, whole[1], part).T
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    return both >= least * (sizes[0][:, None] + sizes[1][None, :] - both)


def _sets_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of some nodes (node), before they are shuffled."""
    return sets.join(few(nodes.distinct()), "node", "left_semi")


def _compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(leader, node, linked): whether the two shingle sets have a Jaccard similarity of ``least`` or more."""

    @F.pandas_udf("boolean")
    def similar_sets(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= least * (len(x) + len(y) - both))
        return pd.Series(out, dtype="bool")

    led = _sets_of(pairs.select(F.col("leader").alias("node")), sets)
    with_x = pairs.join(led.select(F.col("node").alias("leader"), F.col("shingles").alias("sx")), "leader")
    with_y = with_x.join(sets.select("node", F.col("shingles").alias("sy")), "node")
    return with_y.select("leader", "node", similar_sets("sx", "sy").alias("linked"))


def _opened(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(leader, node, root, main, n) of the buckets of three nodes or more, n, that the links leave in several components;
    ``main`` is the component of most of a bucket's nodes. Two nodes have been compared already."""
    known = buckets.join(components(links), "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    main = known.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("leader").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"))
    return staged(known.join(main.where("roots > 1 and n > 2").drop("roots"), "leader"), "open")


def _links_of(found: DataFrame) -> DataFrame:
    x, y = (F.struct(F.col(f"{c}a").alias("a"), F.col(f"{c}b").alias("b")) for c in "xy")
    return found.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).distinct()


_LINK = "xa long, xb long, ya long, yb long"


def _cut(sets: list[np.ndarray], rows: int, elements: int):
    """(start, end) of runs of sets with at most so many rows and elements; one larger set is a run."""
    start = size = 0
    for i, x in enumerate(sets):
        if i > start and (i - start == rows or size + len(x) > elements):
            yield start, i
            start, size = i, 0
        size += len(x)
    if sets:
        yield start, len(sets)


def _between(a: pd.DataFrame, b: pd.DataFrame, least: float, rows: int = 512, elements: int = 1 << 18) -> pd.DataFrame:
    """A link between nodes of two frames (node, root, shingles) for every two roots that have similar sets.

    All pairs are compared, a run of each side at a time, so the working memory does not grow with the frames."""
    links, (one, two), (at, to) = {}, *([[(r["a"], r["b"]) for r in side[c]] for side in (a, b)] for c in ("root", "node"))
    x, y = ([np.frombuffer(s, dtype=np.uint64) for s in side.shingles] for side in (a, b))
    for top, end in _cut(x, rows, elements):
        for start, stop in _cut(y, rows, elements):
            for i, j in zip(*np.nonzero(similar(x[top:end], y[start:stop], least))):
                i, j = i + top, j + start
                if one[i] != two[j]:
                    links[one[i], two[j]] = (*at[i], *to[j])
    return pd.DataFrame(list(links.values()), columns=["xa", "xb", "ya", "yb"]).astype("int64")


def _within(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (x, y) between nodes of different roots that share a bucket of bounded size: members (leader, node, root)."""

    def compare(key, bucket: pd.DataFrame) -> pd.DataFrame:
        return _between(bucket, bucket, least)

    return _links_of(members.join(sets, "node").groupBy("leader").applyInPandas(compare, _LINK))


def _tokens(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``members`` with a row for each of their nodes' shingles (token); those outside the main component with the number
    of shingles they ask for (asks): all but what they must share with the bucket's smallest set, and one."""

    @F.pandas_udf("array<long>")
    def unpacked(column: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=np.int64) for x in column])

    own = members.join(sets, "node").withColumn("size", F.expr("cast(length(shingles) / 8 as int)"))
    own = staged(own.select("leader", "node", "root", "main", "size", unpacked("shingles").alias("tokens")), "members")
    smallest = own.groupBy("leader").agg(F.min("size").alias("smallest"))
    both = F.ceil(least / (1 + least) * (F.col("size") + F.col("smallest")) - 1e-9)
    return own.join(smallest, "leader").select(
        "leader", "node", "root", F.when(F.col("root") != F.col("main"), F.col("size") - both + 1).alias("asks"),
        F.explode("tokens").alias("token"))


def _remaining(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (x, y) between nodes of different components that share a large bucket: members (leader, node, root, main).

    One node of such a link, x, is outside its bucket's main component. The other one has no fewer shingles than the
    bucket's smallest, so the two share a number of them that is known beforehand, and of x's shingles one of any
    (their number - that + 1) is in both. The rarest of the bucket are taken; those that no other component holds ask
    for nothing, which leaves few nodes. They are dealt into blocks of TASK_NODES, and each block meets once the nodes
    that hold what it asks for, PART_NODES at a time.
    """
    members = members.select("leader", "node", "root", "main")
    held = staged(_tokens(members, sets, least), "tokens")
    of = held.groupBy("leader", "token").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    rarest = Window.partitionBy("leader", "node").orderBy("n", "token")  # the shingles of one text
    asked = held.where(F.col("asks").isNotNull()).join(of, ["leader", "token"]).withColumn("nth", F.row_number().over(rarest)).where(
        (F.col("nth") <= F.col("asks")) & (F.col("r1") != F.col("r2")))
    asked = staged(asked.select("leader", "node", "root", "token"), "asked")
    some = asked.groupBy("leader").agg(F.countDistinct("node").alias("m"))
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("all"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / TASK_NODES)).cast("int").alias("block")
    parts = F.ceil(F.col("all") / PART_NODES).cast("int")
    asked = staged(asked.join(some, "leader").join(sizes, "leader").select(
        "leader", "node", "root", "token", block, parts.alias("parts")), "blocks")
    left = asked.select("leader", "block", "parts", "node", "root").distinct().select(
        "leader", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "root").join(sets, "node")
    right = asked.select("leader", "block", "parts", "token").distinct().join(
        held.select("leader", "token", "node", "root"), ["leader", "token"]).select(
        "leader", "block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "root").distinct()
    keys = ["leader", "block", "part"]
    right = right.join(sets, "node").select(*[F.col(c).alias(c) for c in (*keys, "node", "root", "shingles")])
    return _links_of(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: _between(a, b, least), _LINK))


def _connect(posts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (x, y) that connect all nodes with similar sets of shingles in a common bucket: posts (band, node).

    All nodes of a bucket are compared with its leader first; buckets with the same leader are one from then on. What
    that leaves open is compared within a task in buckets of TASK_NODES or fewer. In larger ones, in a few rounds, the nodes outside a bucket's main component are compared with some of that component, chosen by hash,
    which connects most of them at a cost that is linear in their number. What is then left goes to ``_remaining``.
    """
    first = posts.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
    buckets = staged(posts.join(first.where("n > 1"), "band").select("leader", "node").distinct(), "buckets")
    found = _compared(buckets.where("leader <> node"), sets, least).where("linked")
    links = staged(found.select(F.col("node").alias("x"), F.col("leader").alias("y")), "links")
    members = _opened(buckets, links)
    small = members.where(F.col("n") <= TASK_NODES)
    links = staged(links.union(_within(small, _sets_of(small.select("node"), sets), least)), "links")
    members = staged(members.where(F.col("n") > TASK_NODES), "large")
    large = members.select("leader", "node")
    if large.isEmpty():
        return links
    sets = staged(_sets_of(large.select("node"), sets), "large-sets")
    for turn in range(ROUNDS):
        rest = members.where("root <> main")
        left = rest.count()
        if not left:
            return links
        chosen = members.where("root = main").groupBy("leader").agg(F.array_distinct(F.array(*[
            F.min_by("node", F.xxhash64(F.lit(turn), F.lit(i), "node")) for i in range(CHOSEN)])).alias("by"))
        pairs = rest.join(chosen, "leader").select("node", F.explode("by").alias("leader")).distinct()
        found = staged(_compared(pairs, sets, least).where("linked"), "found")
        links = staged(links.union(found.select(F.col("node").alias("x"), F.col("leader").alias("y"))), "links")
        if found.count() * 20 < left:
            break  # the components are much the same; those known so far will do
        members = _opened(large, links)
    return links.union(_remaining(members, sets, least))


@contextmanager
def _short_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Texts and sets are long rows: Arrow batches of the usual length would take 100 MB and more of every task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) as doc_id, node (the text's 128-bit hash), class_id.

    Documents are linked if their texts are equal or their sets of five-word runs have a Jaccard similarity of
    ``least`` or more; classes are the connected components, named by their smallest doc_id. Equal texts are one node
    from the start, so copies cost nothing further.

    Nodes that share a band meet in a bucket. No bucket is expanded into its pairs: its nodes are compared with a leader,
    those outside its main component with some of that one, and what is still open is found by the rarest shingles (see
    ``_connect``, ``_remaining``). Nothing is capped. A link between different texts is missed only if they share no band: below 1e-5
    at a similarity of 0.8 and the default 24 bands of 4.

    A null text is linked to nothing and is its own class; texts without words are linked when equal; a text of fewer
    than five words is one run; long texts are read whole. A null doc_id never names a class that has another. Repeated
    rows come back as often as given. Other columns are not read. Empty tables give empty results.
    """
    with _short_batches(docs.sparkSession):
        return _near_duplicates(docs, least, bands, rows)


def _near_duplicates(docs: DataFrame, least: float, bands: int, rows: int) -> DataFrame:
    named = docs.select("doc_id", "text").withColumn("node", row_key("text"))
    texts = named.where(F.col("text").isNotNull())
    nodes = staged(banded(texts, bands=bands, rows=rows).groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "nodes")

    posts = nodes.select("node", F.explode("bands").alias("band"))
    full = posts.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    posts = staged(posts.join(full, "band").select("band", "node"), "posts")
    words = Shared(docs.sparkSession, "words", None, lambda _: Words())

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words.get())[0].tobytes() for t in column])

    sets = staged(
        texts.select("node", "text").join(few(posts.select("node").distinct()), "node", "left_semi")
        .withColumn("shingles", packed("text")).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    roots = components(_connect(posts, sets, least))

    member = nodes.select("node", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_class = member.groupBy("root").agg(F.min("doc").alias("class_id"))
    classes = staged(member.join(named_class, "root").select("node", "class_id"), "classes")
    return named.select("doc_id", "node", F.col("text").isNull().alias("_null")).join(classes, "node", "left").select(
        "doc_id", "node", F.when(F.col("_null"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def classed_documents(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id; of repeated rows one. Columns are unchanged."""
    node, doc, other, same = free(docs, "node", "d", "n", "same")
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(
        F.col("doc_id").alias(doc), F.col("node").alias(other)).agg(F.count(F.lit(1)).alias(same))
    own = docs.withColumn(node, row_key("text")).join(
        kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(node) == F.col(other)))
    once = own.where(F.col(same) == 1).select(*own_columns(docs))
    return once.union(own.where(F.col(same) > 1).dropDuplicates(["doc_id", node]).select(*own_columns(docs)))
