"""Centroid clustering with ns-bounds: exact Lloyd rounds that evaluate few distances."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Shared, staged

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
LARGEST = 1 << 27

STATE = "cluster int, upper double, upper_round int, lower array<float>, lower_round array<int>"


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Vectors of another length, null ones and those with a component
    that is null or not finite go."""
    x = F.col(f"`{column}`")
    fine = F.when(F.size(x) == dimensions, F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))))
    return vectors.where(fine).select(
        "vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _check(x: np.ndarray) -> None:
    if len(x) and max(int(x.max()), -int(x.min())) > LARGEST:
        raise ValueError(f"scaled components beyond {LARGEST} have squared distances that a long cannot hold")


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: by floats where all sums stay below 2^53."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    out = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return out.astype(np.int64)


class Bounds:
    """What is known of the distances of some vectors: the own centroid from above, each centroid from below, and the
    rounds in which that was evaluated."""

    def __init__(self, cluster, upper, upper_round, lower, lower_round):
        self.cluster, self.upper, self.upper_round = cluster, upper, upper_round
        self.lower, self.lower_round = lower, lower_round

    @classmethod
    def evaluated(cls, x: np.ndarray, centroids: np.ndarray) -> Bounds:
        d = squared_distances(x, centroids)
        cluster = d.argmin(1).astype(np.int32)  # the first of equals
        root = np.sqrt(d.astype(np.float64))
        return cls(cluster, root[np.arange(len(x)), cluster] * (1 + 1e-9), np.zeros(len(x), dtype=np.int32),
                   (root * (1 - 1e-6)).astype(np.float32), np.zeros(d.shape, dtype=np.int32))

    def advance(self, x: np.ndarray, history: np.ndarray) -> int:
        """To the centroids of the last round of ``history`` (rounds, clusters, dimensions); the distances evaluated.

        A bound is loosened by the norm of the centroid's total displacement since its own evaluation, which is never
        more than the sum of the displacements round by round. Where a lower bound does not exceed the upper one, both
        distances are evaluated exactly; equal distances never pass, so ties are settled there.
        """
        now = len(history) - 1
        centroids = history[now]
        moved = np.sqrt(((history - centroids).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)  # (rounds, clusters)
        every, k = np.arange(len(x)), len(centroids)
        low = self.lower - moved[self.lower_round, np.arange(k)[None, :]]
        low[every, self.cluster] = np.inf
        loose = self.upper + moved[self.upper_round, self.cluster]
        at = np.flatnonzero((low <= loose[:, None]).any(1))
        if not len(at):
            return 0
        own = self.cluster[at]
        exact = ((x[at] - centroids[own]) ** 2).sum(1)
        self._note(at, own, exact, now)
        row, other = np.nonzero(low[at] <= self.upper[at][:, None])
        if not len(row):
            return len(at)
        distance = ((x[at[row]] - centroids[other]) ** 2).sum(1)
        self.lower[at[row], other] = np.sqrt(distance.astype(np.float64)) * (1 - 1e-6)
        self.lower_round[at[row], other] = now
        known = np.full((len(at), k), np.iinfo(np.int64).max)
        known[np.arange(len(at)), own] = exact
        known[row, other] = distance
        best = known.argmin(1).astype(np.int32)
        self._note(at, best, known[np.arange(len(at)), best], now)
        self.cluster[at] = best
        return len(at) + len(row)

    def _note(self, at: np.ndarray, cluster: np.ndarray, distance: np.ndarray, now: int) -> None:
        root = np.sqrt(distance.astype(np.float64))
        self.upper[at], self.upper_round[at] = root * (1 + 1e-9), now
        self.lower[at, cluster], self.lower_round[at, cluster] = root * (1 - 1e-6), now

    def columns(self) -> list[pa.Array]:
        n, k = self.lower.shape
        ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
        return [pa.array(self.cluster), pa.array(self.upper), pa.array(self.upper_round),
                pa.ListArray.from_arrays(ends, pa.array(self.lower.reshape(-1))),
                pa.ListArray.from_arrays(ends, pa.array(self.lower_round.reshape(-1)))]

    @classmethod
    def of(cls, batch: pa.RecordBatch, k: int) -> Bounds:
        flat = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "upper_round")]
        return cls(*flat, *[matrix(batch.column(c), k).copy() for c in ("lower", "lower_round")])


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes; a null id comes last, repeated ids by their components."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select(own.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [r.v for r in chosen]


def moved_centroids(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The componentwise floor of each cluster's mean; an empty cluster's centroid stays. A task sends a row a cluster."""
    k, d = len(centroids), len(centroids[0])

    def totals(batches):
        sums, counts = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            used, start = np.unique(cluster[order], return_index=True)
            if len(used):
                sums[used] += np.add.reduceat(matrix(batch.column("v"), d)[order], start, axis=0)
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        ends = pa.array(np.arange(0, len(used) * d + 1, d, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]),
             pa.ListArray.from_arrays(ends, pa.array(sums[used].reshape(-1)))], names=["cluster", "n", "sums"])

    parts = assigned.select("cluster", "v").mapInArrow(totals, "cluster int, n long, sums array<long>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(
        F.sum("part").alias("total"), F.sum("n").alias("n")).collect()  # k times d numbers
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster][r.at] = r.total // r.n
    return out


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v array<long>) as vec_id, cluster, distance (squared, to the final centroid), and the final centroids.

    Exact Lloyd rounds: each assigns every vector to its nearest centroid (ties: the smaller number) and moves the
    centroids. Vectors and their bounds are written to the shared folder once a round, so a lost executor costs one
    task. The driver and the broadcasts hold the centroids of all rounds only, k times dimensions numbers a round.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select("vec_id", "v"), "vectors")
    history = [first_centroids(rows, k, seed)]
    if not history[0]:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    count = len(history[0])
    shape = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<bigint>, {STATE}"

    def step(number: int):
        shared = Shared(spark, f"centroids-{number}", np.array(history, dtype=np.int64))

        def assign(batches):
            past = shared.get()
            for batch in batches:
                x = matrix(batch.column("v"), past.shape[2])
                _check(x)
                if number == 0:
                    bounds = Bounds.evaluated(x, past[0])
                else:
                    bounds = Bounds.of(batch, past.shape[1])
                    bounds.advance(x, past)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), *bounds.columns()],
                    names=["vec_id", "v", "cluster", "upper", "upper_round", "lower", "lower_round"])

        return assign

    for number in range(rounds):
        rows = staged(rows.mapInArrow(step(number), shape), "assigned")
        history.append(moved_centroids(rows, history[-1]))
    final, last = step(rounds), Shared(spark, "final", np.array(history[-1], dtype=np.int64).reshape(count, -1))

    def measured(batches):
        centroids = last.handle.value
        for batch in final(batches):
            x, cluster = matrix(batch.column("v"), centroids.shape[1]), batch.column("cluster")
            distance = ((x - centroids[cluster.to_numpy(zero_copy_only=False)]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), cluster, pa.array(distance)], names=["vec_id", "cluster", "distance"])

    vec_id = rows.schema["vec_id"].dataType.simpleString()
    return staged(rows.mapInArrow(measured, f"vec_id {vec_id}, cluster int, distance long"), "measured"), history[-1]


def clustered_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
                      scale: int = SCALE, seed: int = 1) -> DataFrame:
    """Every kept vector with its cluster, squared distance, sums of these and a digest of the cluster's final centroid.

    Vectors of another length, null ones and those with a null or non-finite component take no part. Fewer vectors than
    clusters give as many clusters as vectors. Repeated rows count as often as they stand there, so they may also start
    two equal centroids, of which the smaller number gets all. A null vec_id starts a centroid only if the others do
    not suffice. Other columns are not read, an empty table gives an empty result. Scaled components beyond 2^27 raise
    an error: their distances would not fit a long.
    """
    spark = vectors.sparkSession
    rows, centroids = clustered(kept_vectors(vectors, dimensions, scale), k, rounds, seed)
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    about = spark.createDataFrame(
        [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(  # a row a cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> str:
    """The same as DuckDB SQL, every distance of every round."""
    def assign(n: int) -> str:
        return f"""
d{n} AS (SELECT rid, cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM kept x CROSS JOIN c{n} c),
a{n} AS MATERIALIZED (SELECT rid, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM d{n} GROUP BY rid)"""

    def move(n: int) -> str:
        return f"""
s{n} AS (SELECT cluster, p, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT a.cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{n} a JOIN kept USING (rid)) GROUP BY ALL),
m{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (cluster))"""

    steps = ",".join(assign(n) + "," + move(n) for n in range(rounds))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (SELECT nth - 1 AS cluster, v FROM (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) AS nth, v FROM kept) WHERE nth <= {k}),
{steps},{assign(rounds)},
t AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM t)::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} c ON a.cluster = c.cluster JOIN t ON a.cluster = t.cluster"""


SQL = sql()
