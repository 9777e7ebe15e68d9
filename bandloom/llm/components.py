"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is a minimum per node and a join, so a node with many neighbours is no task of its own: the minimum is
summed map-side and the join is one that Spark may split. Rounds are written to the shared folder; only a row count
and a checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, keep) -> DataFrame:
    """For each node u of directed pairs, its least neighbour m (or u): edges (v, m) of those neighbours v to keep."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
    own = least.select(F.col("u"), F.col("m").alias("v"))
    moved = joined.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(own).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v) that isn't its own root; root is the least node of the component."""
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was, state = None, _state(now)
    while state != was:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, F.col("v") > F.col("u")), "large")
        now = written(_star(large, F.lit(True)), "small")
        was, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
