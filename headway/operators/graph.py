"""Footpath graph: components and bounded distances, by rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.sources.stages import stage


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that undirected edges a, b reach."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    root = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(root, both.b == root.node).select(F.col("a").alias("node"), "root").unionByName(root)
        new = seen.groupBy("node").agg(F.min("root").alias("root"))
        new = stage(new.join(new.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root")))
        if new.join(root.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty():
            return new
        root = new


def reach(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """source, node, cost within the limit: edges a, b, cost relaxed until nothing improves."""
    known = front = stage(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")))
    while True:
        step = front.withColumnRenamed("cost", "c0").join(edges, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("c0") + F.col("cost")).alias("cost")).where(F.col("cost") <= limit)
        step = step.groupBy("source", "node").agg(F.min("cost").alias("cost"))
        old = known.withColumnRenamed("cost", "was")
        front = stage(step.join(old, ["source", "node"], "left").where("was IS NULL OR cost < was").select("source", "node", "cost"))
        if front.isEmpty():
            return known
        known = stage(known.unionByName(front).groupBy("source", "node").agg(F.min("cost").alias("cost")))
