"""Near-duplicate documents by SimHash: fingerprints, BK-trees over shards of them, components of the links."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged
from tickloom.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
TREE_NODES = 4096
LEVELS = 3

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, part: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included, as an unsigned integer; 0 without words.

    Words lie between ASCII white space, A-Z are lower-cased; a text of fewer words than a shingle is one shingle. A
    bit is set if more than half of the shingles' hashes have it. A long text is counted ``part`` shingles at a time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    run = min(shingle, len(words))
    n = len(words) - run + 1
    starts, stops = (ends - np.diff(ends, prepend=0))[:n].tolist(), (ends[run - 1:] - 1).tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for low in range(0, n, part):
        at = zip(starts[low:low + part], stops[low:low + part])
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in at), dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text, as the long with the same bits."""

    @F.pandas_udf("long")
    def sketch(column: pd.Series) -> pd.Series:
        own = [fingerprint(None if t is None or t != t else t, shingle, seed) for t in column]
        return pd.Series(np.array(own, dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", sketch(F.col(f"`{text}`")).alias("fp"))


class Tree:
    """A BK-tree: the edge to a child is its Hamming distance to the parent, one child per distance."""

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while at < new:
            distance = (value ^ self.values[at]).bit_count()
            if not distance:
                return
            at = self.edges[at].setdefault(distance, new)
        self.values.append(value)
        self.edges.append({})

    def near(self, value: int, radius: int) -> list[int]:
        """All values within ``radius``: of a node's edges only those that differ by the radius or less can lead there."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(self.values[at])
            for edge, child in self.edges[at].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)
        return found


class Forest:
    """Which values are known to be connected; ``join`` tells whether a link was news."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def chunks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` cut into n runs of nearly equal length."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def paths(radius: int, levels: int) -> list[dict[int, list[tuple[int, int]]]]:
    """Per level: path -> its children (path, mask).

    Fingerprints that differ in ``radius`` bits or fewer agree in one of radius + 1 runs of bits, and in the bits
    outside that run again in one of radius + 1 runs, and so on: each level of paths misses no pair.
    """
    out, known = [], {0: (0, list(range(BITS)))}
    for _ in range(levels):
        children, level = {}, {}
        for path, (mask, rest) in known.items():
            for i, run in enumerate(chunks(rest, radius + 1)):
                wider = mask | sum(1 << b for b in run)
                child = path * (radius + 2) + i + 1
                children[child] = wider, [b for b in rest if b not in set(run)]
                level.setdefault(path, []).append((child, wider - (1 << BITS) if wider >> (BITS - 1) else wider))
        out.append(level)
        known = children
    return out


def _posted(df: DataFrame, level: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(path, fp) with each path replaced by its children, and the bits at a child's mask as key."""
    options = F.create_map(*[x for path, to in level.items() for x in (
        F.lit(path), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(m).cast("long").alias("mask")) for c, m in to]))])
    own = df.select("fp", F.explode(options[F.col("path")]).alias("to"))
    return own.select(F.col("to.path").alias("path"), F.col("fp").bitwiseAND(F.col("to.mask")).alias("key"), "fp")


def shards(nodes: DataFrame, radius: int = RADIUS, most: int = TREE_NODES, levels: int = LEVELS) -> DataFrame:
    """(path, key, i, j, asks, fp): the distinct fingerprints dealt into shards of about ``most`` for a tree each.

    Every pair within ``radius`` shares a bucket (path, key) at each level of ``paths``. Buckets of more than ``most``
    fingerprints go down a level. Those still larger at the last one are dealt by hash into shards; shard i's tree is
    then sent to the fingerprints of every shard j > i of its bucket, which ask it.
    """
    done, todo = [], nodes.select(F.lit(0).alias("path"), "fp")
    for n, level in enumerate(paths(radius, levels)):
        posts = _posted(todo, level)
        full = staged(posts.groupBy("path", "key").count().where(F.col("count") > most), "full")
        single = posts.select("path", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("asks"), "fp")
        if full.isEmpty():
            return _union([*done, single])
        done.append(single.join(full.select("path", "key"), ["path", "key"], "left_anti"))
        todo = posts.join(full, ["path", "key"])
        if n < levels - 1:
            todo = staged(todo.select("path", "fp"), "posts")
    count = F.ceil(F.col("count") / most).cast("int")
    own = todo.withColumn("m", count).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    trees = own.select("path", "key", F.col("s").alias("i"), F.explode(F.sequence(F.col("s"), F.col("m") - 1)).alias("j"),
                       F.lit(False).alias("asks"), "fp")
    asking = own.where("s > 0").select("path", "key", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("i"),
                                       F.col("s").alias("j"), F.lit(True).alias("asks"), "fp")
    return _union([*done, trees, asking])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, most: int = TREE_NODES, levels: int = LEVELS) -> DataFrame:
    """(x, y): fingerprints within ``radius`` of each other, as many as connect what one tree finds, not all pairs."""

    def search(batches):
        group, tree, forest = None, Tree(), Forest()
        for batch in batches:
            rows = batch.to_pydict()
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            found = []
            for *own, asks, value in zip(rows["path"], rows["key"], rows["i"], rows["j"], rows["asks"], values):
                if own != group:
                    group, tree, forest = own, Tree(), Forest()
                own_tree = own[2] == own[3]  # a shard's tree meets its own fingerprints once
                if asks or own_tree:
                    found += [(value, y) for y in tree.near(value, radius) if forest.join(value, y)]
                if not asks:
                    tree.add(value)
            if found:
                x, y = (np.array(side, dtype=np.uint64).view(np.int64) for side in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    dealt = shards(nodes, radius, most, levels)
    return (dealt.repartition("path", "key", "i", "j").sortWithinPartitions("path", "key", "i", "j", "asks")
            .mapInArrow(search, "x long, y long").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
            .distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED,
                    most: int = TREE_NODES) -> DataFrame:
    """(doc_id, text) as doc_id, fp (the fingerprint's bits as a long) and component_id, the least doc_id reachable.

    Equal fingerprints are one node, so copies cost nothing further, whatever their number. Nodes are dealt into shards
    that miss no pair within ``radius`` bits; each shard has a BK-tree of bounded size, and only the edges within the
    radius are followed. A tree goes where its shard's fingerprints are, not to all executors: all trees together grow
    with the documents. Links are exact.

    A null text and one without words have fingerprint zero and are linked like any other; a text of one or two words
    is one shingle; long texts are hashed whole. Repeated rows come back as often as given. A null doc_id names a
    component only if no other of its documents has one. Other columns are not read. Empty tables give empty results.
    """
    sketches = staged(fingerprints(docs.select("doc_id", "text"), "text", shingle, seed), "fingerprints")
    nodes = staged(sketches.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    roots = components(staged(links(nodes, radius, most), "links"))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = staged(member.join(least, "root").select("fp", "component_id"), "components")
    return sketches.join(named, "fp").select("doc_id", "fp", "component_id")


def linked_documents(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
