"""Dictionaries: dense ids of nodes and labels, and their lookups.

Null endpoints are no nodes: they get no id, and edges with one drop out of the encoded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoplite.plans.workspace import Workspace
from hoplite.schema import NO_NODE


def endpoints_of(edges: DataFrame, src: str = "start_id", dst: str = "end_id") -> DataFrame:
    """Each distinct endpoint once, as ``str_id``."""
    both = edges.select(F.explode(F.array(src, dst)).alias("str_id"))
    return both.where("str_id is not null").distinct()


def dense_ids(keys: DataFrame, key: str, id_name: str, work: Workspace, name: str) -> DataFrame:
    """Number distinct keys from 0 in ascending (bytewise) order.

    Keys are dealt to ranges, numbered within each range in parallel, and moved on by
    the number of keys in the ranges below. The ranges are written first, as
    their bounds come from a sample; only one row per range meets in one place.
    """
    dealt = work.put(keys.select(key).repartitionByRange(key).select(key, F.spark_partition_id().alias("_part")), f"{name}_ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    below = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_below"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn("_i", within).join(F.broadcast(below), "_part").select((F.col("_below") + F.col("_i")).cast("long").alias(id_name), key)


def node_dictionary(edges: DataFrame, work: Workspace) -> DataFrame:
    """``(id, str_id)`` of all endpoints, dense, in bytewise order of the text."""
    return work.put(dense_ids(endpoints_of(edges), "str_id", "id", work, "nodes"), "nodes")


def string_to_id(probes: DataFrame, nodes: DataFrame, column: str = "str_id") -> DataFrame:
    """``probes`` with ``id``; text that is no node gives 4294967295."""
    known = nodes.select(F.col("str_id").alias("_s"), F.col("id").alias("_id"))
    return probes.join(known, F.col(column) == F.col("_s"), "left").withColumn("id", F.coalesce("_id", F.lit(NO_NODE))).drop("_s", "_id")


def id_to_string(probes: DataFrame, nodes: DataFrame, column: str = "id") -> DataFrame:
    """``probes`` with ``str_id``; an id out of range gives empty text."""
    known = nodes.select(F.col("id").alias("_i"), F.col("str_id").alias("_s"))
    return probes.join(known, F.col(column) == F.col("_i"), "left").withColumn("str_id", F.coalesce("_s", F.lit(""))).drop("_i", "_s")


def encoded_edges(edges: DataFrame, nodes: DataFrame, keep: tuple[str, ...] = (), src: str = "start_id", dst: str = "end_id") -> DataFrame:
    """``(src, dst)`` as ids, one row per edge, with further columns on request. Either join may be skewed by a hub; both can be split."""
    a = nodes.select(F.col("str_id").alias(src), F.col("id").alias("src"))
    b = nodes.select(F.col("str_id").alias(dst), F.col("id").alias("dst"))
    return edges.select(src, dst, *keep).join(a, src).join(b, dst).select("src", "dst", *keep)


def first_seen_ids(values: DataFrame, order: Column, id_name: str, name: str) -> DataFrame:
    """Number ``values(name)`` by first appearance. Only one row per distinct value is ordered in one place."""
    firsts = values.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("_first"))
    return firsts.select((F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias(id_name), name)


def label_dictionary(edges: DataFrame, line: str = "line_no") -> DataFrame:
    """``(label_id, label)`` of node labels in first-seen order, the start label before the end label of a line."""
    both = edges.select(line, F.posexplode(F.array("start_label", "end_label")).alias("pos", "label"))
    return first_seen_ids(both, F.struct(line, "pos"), "label_id", "label")


def relation_dictionary(edges: DataFrame, line: str = "line_no") -> DataFrame:
    """``(relation_id, relation)`` of edge labels in first-seen order."""
    return first_seen_ids(edges.select(line, F.col("edge_label").alias("relation")), F.col(line), "relation_id", "relation")
