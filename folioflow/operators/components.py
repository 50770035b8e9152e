"""Connected components of large graphs, in rounds that grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import removed, written


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """node, group (the least node reachable) of edges (a, b) of one type, and the rounds that it took. Nulls join nothing.

    Each round points the larger neighbours of a node at its least one, then the node itself and its smaller ones: paths
    halve again and again until every node points at its group. Least neighbours are sums of a kind (partial in each
    task), so a node of many edges is split; rounds are written, and the ones before them are deleted.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, rounds = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "edges")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(now)
        now, rounds = after, rounds + 1
        if sign == seen:
            break
        seen = sign
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(roots), rounds
