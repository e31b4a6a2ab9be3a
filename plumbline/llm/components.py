"""Connected components of an edge table."""

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.staging import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the edges (a, b) but the roots.

    Large-star and small-star rounds: each node hands its neighbours on to the smallest of them, until every
    edge ends in a root. Only counts and sums of the edges reach the driver.
    """
    edges = cut(_ordered(edges))
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = _ordered(large)
        # b is the larger end: its smaller neighbours go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("least"))
        small = large.join(least, "b").select("b", "a", "least")
        edges = cut(_ordered(small.select(F.col("a"), F.col("least").alias("b")).union(small.select(F.col("b").alias("a"), F.col("least").alias("b")))))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the smaller end first, without loops."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
