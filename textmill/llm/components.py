"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, materialize


def _finished(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: each u has one edge, and no v is the u of another."""
    marks = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root"))
    marks = marks.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    counts = marks.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return counts.filter("child > 1 OR child = 1 AND root = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    to_least = edges.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that has an edge: component is the smallest node reachable.

    edges: columns u and v, in any direction; loops and repeats do no harm. Groups are never collected: each step
    takes minima with partial aggregation and joins them back. Each step is written to the shared folder."""
    now = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not now.isEmpty() and not _finished(now):
        step = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now = step
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def extended(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components (node, component) after more edges (u, v): only the components that these join are worked on."""
    label = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    ends = edges.join(label("u"), "u", "left").join(label("v"), "v", "left")
    ends = ends.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("_c"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(components, "node", "left_anti")
    whole = components.select("node", "component").unionByName(nodes.select("node", F.col("node").alias("component")))
    return whole.join(joined, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
