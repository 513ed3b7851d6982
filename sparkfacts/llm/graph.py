"""Connected components over edges of any size, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable, for nodes with edges.

    ``edges`` has two long columns a and b. Each round joins every node's larger
    neighbours, then its smaller ones, to the smallest of them; rounds grow with the
    logarithm of the longest path. Only minima are gathered per node, never neighbour
    lists, and each round is a written table.
    """
    a, b = F.col("a"), F.col("b")
    spark = edges.sparkSession
    since = len(held(spark))
    seen = None  # rows of the last round, as their count and the sum of their hashes
    pairs = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a > b).distinct(), "edges")
    while True:
        # large star: larger neighbours of a node go to its smallest neighbour (or itself)
        both = pairs.unionByName(pairs.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter(a > b)
        # a node that is nobody's smallest keeps its own link
        large = staged(large.distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter(b > F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        small = staged(small.distinct(), "small")
        discard(spark, since, keep=1)
        before, seen = seen, small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return small.select(a.alias("node"), b.alias("component")).unionByName(small.select(b.alias("node"), b.alias("component")).distinct())
        pairs = small
