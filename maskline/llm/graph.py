"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> node, root: the smallest node that each node reaches; nodes without an edge don't appear.

    Large-star and small-star steps in turn (each edge set stays as large as the first or shrinks; the number of
    rounds grows with the logarithm of the nodes). Every round is written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small, "small-star")
        state = [e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first() for e in (edges, after)]
        if state[0] == state[1]:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = after
