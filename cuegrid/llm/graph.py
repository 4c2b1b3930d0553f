"""Distributed union-find over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """(node, root) for edges(a, b): root is the least node of the component. Nodes are longs; null ends are no edge.

    Alternating large-star and small-star steps: each points a node's neighbours at the least node near it,
    as minima by key (partial before the shuffle) and a join. Ends when a round changes nothing; a chain of
    n nodes takes about log n rounds. Each round is written to the scratch folder and the one before it deleted.
    """
    now = s(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, s(small.where(F.col("a") != F.col("b")).distinct())
        s.drop(before)
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(got) == sign:
            break
        sign = tuple(got)
    return s(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    ))
