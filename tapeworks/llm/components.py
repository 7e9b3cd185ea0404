"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component) for every vertex of links (a, b): the smallest vertex that it reaches.

    In each round every vertex points to that one of itself and its neighbours which a hash of the round puts first; links then are drawn between what their
    ends point to, and those within one vertex go. A constant share of the vertices goes each round, long chains and hubs alike, so the links shrink fast. Sums over a
    hub's links are pre-aggregated. Links and pointers stay in tables.
    """
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    roots = scratch.keep(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("root", F.col("v")), "roots")
    number = 0
    while not edges.isEmpty():
        number += 1

        def turn(c: str, number: int = number):
            return F.struct(F.xxhash64(F.lit(number), c), F.col(c).alias("to"))

        ends = edges.select(F.col("a").alias("v"), "b").union(edges.select("b", "a"))
        first = ends.groupBy("v").agg(F.min(turn("b")).alias("near"))
        first = scratch.keep(first.select("v", F.least("near", turn("v"))["to"].alias("to")), "pointers")
        drawn = edges.join(first.select(F.col("v").alias("a"), F.col("to").alias("to_a")), "a").join(first.select(F.col("v").alias("b"), F.col("to").alias("to_b")), "b")
        drawn = drawn.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        fresh = scratch.keep(drawn, "links")
        moved = roots.join(first.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        moved = scratch.keep(moved, "roots")
        scratch.drop(edges, roots, first)
        edges, roots = fresh, moved
    least = roots.groupBy("root").agg(F.min("v").alias("component"))
    return scratch.keep(roots.join(least, "root").select("v", "component"), "components")
