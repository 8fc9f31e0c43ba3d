"""Exact top-k search by sorted lists without random access."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged

BLOCK_ROWS = 4096
QUERY_ROWS = 4096


def quantised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(256 * x). Null vectors and those with a null or non-finite component go."""
    x = F.col(f"`{vector}`")
    fine = x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return df.where(fine & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("long")).alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def survivors(values: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """Yields (query, rows that can be among its k best, their scores), reading one sorted list per dimension.

    A positive query component reads its list from the largest value down, a negative one from the smallest up, all
    lists to the same depth, round by round. What a round reads is added to a row's lower bound, in which unread
    components stand for the list's end; in the upper bound they stand for the next unread entry. Rows whose upper
    bound is below the k-th best lower bound are out; a query stops reading when no more than k are left. Scores of
    what is left are resolved in the end. ``own`` marks (query, row) pairs that do not count. Integers up to 2^53 are
    exact in the floats used here.
    """
    rows = len(values)
    order = np.argsort(values, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(rows)[:, None], axis=0)
    ordered = np.take_along_axis(values, order, axis=0)
    alive, active = ~own.T, np.arange(len(queries))
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    least = np.repeat((ordered[0] @ up + ordered[-1] @ down)[None, :], rows, axis=0)
    read = 0
    for depth in [rows // 8, rows // 4, rows // 2, rows - rows // 4, rows - rows // 8] if rows > 8 * k else []:
        if depth <= read:
            continue
        top, bottom = rank >= rows - depth, rank < depth
        new_top, new_bottom = top & (rank < rows - read), bottom & (rank >= read)
        u, d = up[:, active], down[:, active]
        low = least[:, active]
        low += np.where(new_top, values - ordered[0], 0) @ u + np.where(new_bottom, values - ordered[-1], 0) @ d
        # beyond the lower bound, unread components may gain what lies between the list's end and its next entry
        gain_up, gain_down = ordered[rows - depth - 1] - ordered[0], ordered[depth] - ordered[-1]
        most = low + (~top).astype(float) @ (u * gain_up[:, None]) + (~bottom).astype(float) @ (d * gain_down[:, None])
        least[:, active] = low
        low = np.where(alive[:, active], low, -np.inf)
        bound = np.partition(low, rows - k, axis=0)[rows - k]
        alive[:, active] &= most >= bound
        read, active = depth, active[alive[:, active].sum(0) > k]
        if not len(active):
            break
    for q in range(len(queries)):
        at = np.flatnonzero(alive[:, q])
        yield q, at, values[at] @ queries[q]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS, row: str = "vec_id") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``: query_id, rank, vec_id, score.

    Both are (vec_id, v array<long>), and ``row`` if that is not the vec_id: what tells rows apart. A block of candidates holds its own sorted lists and answers a block of queries;
    the blocks' winners, k per query and block, meet afterwards. Of equal vectors only the k + 1 smallest ids can be
    among any k best, so a vector that a third of the rows share costs k + 1 rows.

    Ties go to the smaller vec_id, a query never finds the row it is itself, rows that agree in ``row`` and vector count
    once, a shorter vector counts as padded with zeros, and fewer than k candidates give fewer rows.
    """
    named = [F.col("vec_id"), F.col(row).alias("row"), F.col("v")]
    same = Window.partitionBy("v").orderBy("vec_id", "row")
    few = (vectors.select(*named).dropDuplicates(["vec_id", "row", "v"])
           .withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k + 1).drop("_nth"))
    few, asked = staged(few, "candidates"), staged(queries.select(*named).dropDuplicates(), "queries")
    blocks, groups = max(1, math.ceil(few.count() / block_rows)), max(1, math.ceil(asked.count() / query_rows))

    def spread(df, own, n, other, m):
        return df.select(
            "vec_id", "row", "v", F.pmod(F.xxhash64("row", "vec_id"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_row", "vec_id", "row", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        width = max(left.v.map(len).max(), right.v.map(len).max())
        ids, at_row, asked_ids, asked_rows = (c.to_numpy() for c in (right.vec_id, right.row, left.vec_id, left.row))
        values, out = matrix(right.v, width), []
        for start in range(0, len(left), 256):
            part, own = asked_ids[start:start + 256], asked_rows[start:start + 256]
            wanted = matrix(left.v.iloc[start:start + 256], width)
            for q, at, score in survivors(values, wanted, own[:, None] == at_row[None, :], k):
                first = np.lexsort((at_row[at], ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": part[q], "query_row": own[q], "vec_id": ids[at][first],
                                         "row": at_row[at][first], "score": score[first]}))
        return pd.concat(out).astype("int64")

    found = (
        spread(asked, "_g", groups, "_b", blocks).groupBy("_b", "_g")
        .cogroup(spread(few, "_b", blocks, "_g", groups).groupBy("_b", "_g"))
        .applyInPandas(best, "query_id long, query_row long, vec_id long, row long, score long"))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def every_fiftieth(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Queries: the rows whose id is divisible by 50; candidates: every other row, also one with the same id. Each of
    several query rows with one id has a ranking of its own."""
    whole = staged(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    return top_k(whole, whole.where(F.col("vec_id") % 50 == 0), k, row="row")
