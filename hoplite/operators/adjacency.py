"""Degrees, neighbour lists and CSR offsets, in either direction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplite.functions.codec import varint_length
from hoplite.plans.workspace import Workspace
from hoplite.schema import U32

#: Ids of a block of the two-level running sum.
BLOCK = 1 << 16


def turned(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(node, peer)``: the node whose list an edge belongs to, and what it adds. Multi-edges and loops stay."""
    if direction == "out":
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("peer"))
    if direction == "in":
        return edges.select(F.col("dst").alias("node"), F.col("src").alias("peer"))
    if direction == "both":
        return turned(edges, "out").unionByName(turned(edges, "in"))
    raise ValueError(f"direction {direction!r}")


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count"))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edge_count"))


def degrees(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(id, degree)`` of every node, 0 included; multi-edges count each."""
    counts = turned(edges, direction).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_lookup(probes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """``probes(id)`` with their degree; 0 for an id out of range."""
    wanted = turned(edges, direction).join(probes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    counts = wanted.groupBy("node").agg(F.count("*").alias("degree"))
    return probes.join(counts, F.col("id") == F.col("node"), "left").select(*probes.columns, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def _ranged(rows: DataFrame, work: Workspace) -> DataFrame:
    """``rows`` with ``_part``, the number of the range of ``(node, peer)`` that they fall in: a hub spans as many ranges as it
    needs. Written, as the bounds of ranges come from a sample."""
    name = f"ranges{next(_names)}"
    return work.put(rows.repartitionByRange("node", "peer").withColumn("_part", F.spark_partition_id()), name)


_names = count()


def neighbour_rows(edges: DataFrame, direction: str = "out", work: Workspace | None = None) -> DataFrame:
    """``(node, rank, peer)``: neighbours one per row in ascending order, for lists of any length: ranks within
    a range of a node's neighbours, moved by the node's rows in the ranges below. Equal edges are ranked within one row."""
    work = work or Workspace(edges.sparkSession, "neighbours")
    rows = _ranged(turned(edges, direction).groupBy("node", "peer").agg(F.count("*").alias("_n")), work)
    inside = F.sum("_n").over(Window.partitionBy("_part", "node").orderBy("peer")) - F.col("_n")
    sizes = rows.groupBy("_part", "node").agg(F.sum("_n").alias("_s"))
    below = sizes.select("_part", "node", (F.sum("_s").over(Window.partitionBy("node").orderBy("_part")) - F.col("_s")).alias("_below"))
    ranked = rows.withColumn("_i", inside).join(below, ["_part", "node"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return ranked.select("node", (F.col("_below") + F.col("_i")).alias("_first"), "peer", every.alias("_k")).select("node", (F.col("_first") + F.col("_k")).alias("rank"), "peer")


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(node, list)`` of nodes with any neighbour, ascending, with duplicates. A list is one row's value and so
    bounded by a row's size; `neighbour_rows` has no such bound."""
    return turned(edges, direction).groupBy("node").agg(F.array_sort(F.collect_list("peer")).alias("list"))


def neighbour_lookup(probes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """``probes(id)`` with their list; empty for a sink and for an id out of range."""
    wanted = turned(edges, direction).join(probes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    found = wanted.groupBy("node").agg(F.array_sort(F.collect_list("peer")).alias("list"))
    return probes.join(found, F.col("id") == F.col("node"), "left").select(*probes.columns, F.coalesce("list", F.array().cast("array<bigint>")).alias("list"))


def running_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over dense ids ``key``, in two levels: within blocks of ids in parallel, then over one row per block."""
    blocks = df.withColumn("_block", F.floor(F.col(key) / BLOCK))
    totals = blocks.groupBy("_block").agg(F.sum(value).alias("_t"))
    before = totals.select("_block", (F.sum("_t").over(Window.orderBy("_block")) - F.col("_t")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(key)) - F.col(value)
    return blocks.withColumn("_inside", inside).join(before, "_block").withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_inside", "_before")


def compressed_sizes(edges: DataFrame, direction: str = "out", work: Workspace | None = None) -> DataFrame:
    """``(node, edges, bytes)``: length of each neighbour list and of its code, without building a list.

    Differences are taken within ranges of ``(node, peer)``; the first row of a range takes its predecessor from the ends
    of the ranges below, one row each. An equal edge adds a difference of 0, one byte.
    """
    work = work or Workspace(edges.sparkSession, "sizes")
    rows = _ranged(turned(edges, direction).groupBy("node", "peer").agg(F.count("*").alias("_n")), work)
    order = Window.partitionBy("_part").orderBy("node", "peer")
    ends = rows.groupBy("_part").agg(F.max(F.struct("node", "peer")).alias("_end"))
    before_part = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_e"))
    here = rows.withColumn("_p", F.lag(F.struct("node", "peer")).over(order)).join(F.broadcast(before_part), "_part")
    last = F.coalesce("_p", "_e")
    before = F.when(last["node"] == F.col("node"), last["peer"]).otherwise(0)
    sized = here.withColumn("_b", varint_length(F.pmod(F.col("peer") - before, F.lit(U32))) + F.col("_n") - 1)
    return sized.groupBy("node").agg(F.sum("_n").alias("edges"), F.sum("_b").alias("bytes"))


def csr_offsets(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(node_id, edge_offset, byte_offset)``: N + 1 rows; the first place of a node's neighbours among all edges, and
    the first byte of its compressed list among all lists. The last row holds the totals."""
    lists = compressed_sizes(edges, direction).select("node", F.col("edges").alias("_edges"), F.col("bytes").alias("_bytes"))
    every = nodes.select(F.col("id").alias("node_id")).join(lists, F.col("node_id") == F.col("node"), "left")
    every = every.select("node_id", F.coalesce("_edges", F.lit(0)).alias("_edges"), F.coalesce("_bytes", F.lit(0)).alias("_bytes"))
    end = nodes.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("node_id")).select("node_id", F.lit(0).cast("long").alias("_edges"), F.lit(0).cast("long").alias("_bytes"))
    every = every.unionByName(end)
    sums = running_sum(running_sum(every, "node_id", "_edges", "edge_offset"), "node_id", "_bytes", "byte_offset")
    return sums.select("node_id", "edge_offset", "byte_offset")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Edges ordered by (src, dst), over all partitions."""
    return edges.orderBy("src", "dst")


def clustered_edges(edges: DataFrame) -> DataFrame:
    """Edges in ranges of ``(src, dst)``, ordered within: a source's edges are neighbours, and a hub spans ranges."""
    return edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
