"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged


def components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, root): the smallest node of the component, for every node that has a link.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are hung on its
    smallest neighbour. Every step is two aggregations of the links, which shrink to stars in about log(n) rounds; the
    links of each round are written to the shared folder. Only a checksum of them comes to the driver.
    """
    def mark(edges):
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 65_521)).first())

    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = mark(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = staged(small.select("u", F.col("m").alias("v")).union(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        before, seen = seen, mark(edges)
        if seen == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def labels(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, label): the smallest node two links away. Nodes with the same label are connected; not all connected
    nodes have the same one."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a)))
    near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = near.select(F.col("u").alias("v"), F.col("m").alias("f"))
    return near.join(far, near.m == far.v).select(F.col("u").alias("node"), F.least("m", "f").alias("label"))
