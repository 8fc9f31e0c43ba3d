"""SimHash links, clusters with ns-bounds and importance resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tickloom.llm import clustering, resampling, simhash

EXTRA = ["fp", "root", "path", "key", "cluster", "v", "w", "row", "at", "part", "score", "rank", "_null"]


@pytest.fixture(scope="module")
def rows():
    return cases.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.frame(spark, rows).repartition(3).cache()


def with_extra(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns})


# 11 ------------------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in low.encode().split()]
    runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=3):
    """Per fingerprint the smallest one reachable, all pairs compared."""
    known = sorted(set(prints))
    root = {p: p for p in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= radius:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {p: find(p) for p in known}


def want_components(rows, radius=3):
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    root = plain_components([p for _, p in prints], radius)
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    return sorted(((d, f"{p:016x}", least.get(root[p])) for d, p in prints), key=str)


def test_simhash_equals_all_pairs(spark, docs, rows):
    out = sorted(map(tuple, simhash.linked_documents(with_extra(docs)).collect()), key=str)
    assert out == want_components(rows)
    assert len({c for _, _, c in out}) < len(rows) - 5


def test_simhash_of_odd_rows(spark):
    rnd = random.Random(3)
    words = cases.vocabulary(rnd, 2000)
    long = " ".join(rnd.choice(words) for _ in range(80_000))  # more shingles than are counted at once
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one  two", "É é", long, long + " end", "one two three four"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (3, "One"), (None, "one two"), (None, "alone here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.linked_documents(df).collect()), key=str) == want_components(rows)
    empty = simhash.linked_documents(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("most,levels", [(4096, 3), (40, 3), (40, 1), (7, 2)])
def test_links_of_dense_fingerprints(spark, most, levels):
    """Small shards, so buckets go down all levels and are dealt into several trees at the last."""
    rnd = random.Random(most)
    centre = [rnd.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    near = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centre for _ in range(60)}
    near |= {rnd.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in near], "fp long")
    found = [(x % (1 << 64), y % (1 << 64)) for x, y in simhash.links(df, most=most, levels=levels).collect()]
    assert all((x ^ y).bit_count() <= 3 for x, y in found) and len(found) == len(set(found))
    root = {p: p for p in near}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in found:
        low, high = sorted((find(x), find(y)))
        root[high] = low
    assert {p: find(p) for p in near} == plain_components(near)


def test_tree_follows_few_edges():
    rnd = random.Random(9)
    values = [rnd.getrandbits(64) for _ in range(800)]
    tree = simhash.Tree()
    for v in values + values[:5]:
        tree.add(v)
    assert tree.values == values
    for _ in range(100):
        asked = rnd.choice(values) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        assert sorted(tree.near(asked, 3)) == sorted(v for v in values if (v ^ asked).bit_count() <= 3)


# 12 ------------------------------------------------------------------------------------------------------------------

def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, centres[j])), j)) for _, v in kept]
        if turn < rounds:
            groups = {}
            for c, (_, v) in zip(own, kept):
                groups.setdefault(c, []).append(v)
            centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    far = [sum((a - b) ** 2 for a, b in zip(v, centres[c])) for c, (_, v) in zip(own, kept)]
    total = Counter()
    for c, d in zip(own, far):
        total[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, total[c], sum(far), digest[c]) for (i, _), c, d in zip(kept, own, far)), key=str)


@pytest.mark.parametrize("k,rounds", [(5, 3), (12, 6), (400, 2)])
def test_clusters_equal_all_distances(spark, k, rounds):
    rnd = np.random.default_rng(k)
    centre = rnd.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centre[i % 6] + rnd.normal(size=8) * 0.4]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(7, rows[7][1])] * 3 + [(None, rows[9][1])]
    rows += [(900, None), (901, rows[0][1][:7]), (902, [None] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8),
             (905, [0.0] * 8), (906, [0.0] * 8), (907, [-0.01] * 8)]
    df = with_extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(3)
    out = clustering.clustered_vectors(df, k, rounds, 8, 64)
    assert sorted(map(tuple, out.collect()), key=str) == plain_clusters(rows, k, rounds, 8, 64)
    empty = clustering.clustered_vectors(df.limit(0), k, rounds, 8, 64)
    assert empty.count() == 0 and empty.columns == out.columns


def test_bounds_spare_distances_and_stay_exact():
    rnd = np.random.default_rng(1)
    centre = rnd.integers(-60, 60, (16, 64))
    x = centre[rnd.integers(0, 16, 3000)] + rnd.integers(-9, 10, (3000, 64))
    history = [x[:16].copy()]
    bounds = clustering.Bounds.evaluated(x, history[0])
    for _ in range(8):
        used = np.bincount(bounds.cluster, minlength=16)
        sums = np.zeros((16, 64), dtype=np.int64)
        np.add.at(sums, bounds.cluster, x)
        history.append(np.where(used[:, None] > 0, sums // np.maximum(used, 1)[:, None], history[-1]))
        spent = bounds.advance(x, np.array(history))
        assert (bounds.cluster == clustering.squared_distances(x, history[-1]).argmin(1)).all()
    assert spent < len(x)  # of 16 times as many


def test_large_components():
    x = np.array([[1 << 27, -(1 << 27)], [0, 1]])
    assert clustering.squared_distances(x, -x).tolist() == [
        [sum((int(a) + int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]
    with pytest.raises(ValueError):
        clustering._check(x * 2)


# 13 ------------------------------------------------------------------------------------------------------------------

def plain_runs(text):
    w = cases.bench_words(text)
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def plain_draw(rows, items):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    of = [(d, *plain_runs(t)) for d, t, *_ in rows]
    s, t = Counter(bucket(f) for _, own, _ in of for f in own), Counter(bucket(f) for i in items for f in plain_runs(i)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d, own, n in of:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, own)]
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = sum(gain) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, n, len(own), sum(gain), score))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = 5 * len(able) // 100
    return ([(d, f, w, sc, i + 1 if i < drawn else None) for i, (d, _, f, w, sc) in enumerate(able)]
            + [(d, f, w, sc, None) for d, n, f, w, sc in out if n < 20])


def test_draw_equals_plain(spark, docs, rows, monkeypatch):
    items = [rows[7][1], rows[5][1], None, "", "12 !?", rows[2][1]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, w int")
    more = [(i + 1000, *r[1:]) for i, r in enumerate(rows)] + [(None, rows[11][1], None, None, 0), (5, *rows[5][1:])] + [
        (3000, "x" * 700 + " " + "y" * 600 + " 1 2 3", None, None, 0)] + [(70, rows[7][1], None, None, 0)] * 30
    both = with_extra(docs.union(cases.frame(spark, more)))
    out = resampling.resampled_documents(both, bench)
    want = plain_draw(rows + more, items)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    kept = resampling.drawn_documents(both, bench)
    assert kept.columns == both.columns
    names = {d for d, *_, r in want if r}
    assert kept.count() == sum(d in names for d, *_ in rows + more)
    assert resampling.resampled_documents(both.limit(0), bench).count() == 0
    assert resampling.resampled_documents(docs, bench.limit(0)).count() == len(rows)


def test_features_in_slices(monkeypatch):
    """Cut anywhere, a text has the same features; CRCs by matrix equal those of the library."""
    rnd = random.Random(6)
    words = cases.vocabulary(rnd, 60)
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (300, 0, 1, 2, 3, 90)] + ["é" * 400 + " a " + "b" * 900]
    for size in (1, 7, 64, 1 << 21):
        monkeypatch.setattr(resampling, "SLICE", size)
        monkeypatch.setattr(resampling, "MATRIX_CELLS", 1000)
        found = Counter((o, b) for part in resampling.slices(texts, 3)
                        for own, buckets in resampling.features(part, 3, 10_000) for o, b in zip(own.tolist(), buckets.tolist()))
        assert found == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in plain_runs(t)[0])
