"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.session import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour (large: the larger ones) of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        tied = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return tied.where(F.col("u") > F.col("v")).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every larger end has one edge, to a node that is no larger end itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"))
    )
    uses = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return uses.where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the component, for every node of (a, b) edges."""
    now = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(),
        "components",
    )
    while not _stars_only(now):
        now = stage(_stars(_stars(now, large=True), large=False), "components")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
