"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, stored


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(id, component): for each id in ``edges`` (a, b; of any ordered type) the smallest id that it is connected with.

    Alternates two steps until neither changes an edge. Large star: each node
    hands its smallest neighbour to all its larger ones. Small star: each node
    hands its smallest neighbour to itself and its smaller ones. Every step is one
    grouping and one join; the minimum per node is aggregated before the shuffle,
    and a node with many edges is an ordinary skewed join, which Spark splits.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not before["n"]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")), label)
        large = stored(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), label)
        down = stored(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), label)
        small = large.join(down, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        done = [edges, least, large, down]
        edges = stored(small.where("a <> b").distinct(), label)
        for old in done:
            forgotten(old)
        after = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if after == before:
            break
    # stars now: every id points at the smallest of its component
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
