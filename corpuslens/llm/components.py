"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for each node of edges(a, b) but the smallest ones.

    Every round is a few joins on the edge table, which is written to the shared folder; nothing goes to the driver but a
    count and a checksum. A node with very many edges is one row on the other side of each join, so its rows can be split.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
        least = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").where("n > v").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges, old = stored(small.distinct()), edges
        release(old)
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
