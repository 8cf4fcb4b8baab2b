"""Connected components by alternating star contractions, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplite.plans.workspace import Workspace


def connected_components(links: DataFrame, work: Workspace, label: str = "cc") -> DataFrame:
    """``links(a, b)`` to ``(id, comp)``: every linked id with the smallest id that it can reach.

    Each round gives every neighbour above a node, then every neighbour below
    it, to the smallest node next to it; the forest flattens to stars in a number of
    rounds that grows with the logarithm of the diameter. Hubs meet only in
    partial ``min`` aggregations and in joins that can be split.
    """
    edges = work.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}0")
    step = 0
    while not _is_flat(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.put(large.where("u <> v").distinct(), f"{label}{step + 1}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = work.put(small.where("u <> v").distinct(), f"{label}{step + 2}")
        work.drop(f"{label}{step}", f"{label}{step + 1}")
        step += 2
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(tops)


def _is_flat(edges: DataFrame) -> bool:
    """Whether ``edges(u, v)`` are stars: every u has one v, and no v is a u. Connected parts are then the components, and v is their least."""
    several = edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1")
    return several.isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
