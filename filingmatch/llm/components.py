"""Connected components by alternating large and small stars, each round a group-by-minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import join_back


def _least(edges: DataFrame, own: bool) -> DataFrame:
    """The smallest neighbour of every `u` and its number of edges; with `own`, `u` itself counts as a neighbour."""
    low = F.min("v")
    return edges.groupBy("u").agg((F.least(low, F.col("u")) if own else low).alias("m"), F.count(F.lit(1)).alias("n"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b long): root is the smallest node that can be reached. No links, no rows.
    A node with very many neighbours is one row of a combined minimum, and its edges stay spread out in the join."""
    spark = links.sparkSession
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark, folders = now, [path]
        both, p1 = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        low, p2 = stored(_least(both, True), "least")
        large = join_back(both.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star, p3 = stored(large.where("u <> v").distinct(), "large")
        low, p4 = stored(_least(star, False), "least")
        met = join_back(star, low, "u", "n")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges, path = stored(small.distinct(), "edges")
        for p in (*folders, p1, p2, p3, p4):
            discard(spark, p)
