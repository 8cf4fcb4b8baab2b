"""K-hop neighbourhoods of many queries at once.

A query has seeds (``items``), a hop limit (``length``) and edge labels (``labels``; none: all). It counts the
distinct nodes at a minimum distance from 1 to ``length`` from any seed; the seeds themselves never
count, unknown seeds reach nothing, a limit of 0 or less gives 0. Each hop is one
join of the frontier with the adjacency, one ``distinct`` and one anti join with what
was reached before; the frontier is written after each hop, so plans do not grow.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.plans.workspace import Workspace
from hoplite.schema import QUERY


@dataclass(frozen=True)
class KHopQuery:
    """Seeds, hop limit and edge labels of one query."""

    items: tuple[str, ...] = ()
    length: int = 0
    labels: tuple[str, ...] = field(default=())

    def with_items(self, *items: str) -> "KHopQuery":
        return replace(self, items=items)

    def with_length(self, length: int) -> "KHopQuery":
        return replace(self, length=length)

    def with_labels(self, *labels: str) -> "KHopQuery":
        return replace(self, labels=labels)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(list(self.items), self.length, list(self.labels))], QUERY).select(F.lit(0).cast("long").alias("req"), "*")


def adjacency(edges: DataFrame, direction: str = "out", labelled: bool = False) -> DataFrame:
    """Distinct ``(node, peer)``, with ``edge_label`` if ``labelled``."""
    labels = ["edge_label"] if labelled else []
    ahead = edges.select(F.col("start_id").alias("node"), F.col("end_id").alias("peer"), *labels)
    back = edges.select(F.col("end_id").alias("node"), F.col("start_id").alias("peer"), *labels)
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction {direction!r}")
    both = ahead if direction == "out" else back if direction == "in" else ahead.unionByName(back)
    return both.where("node is not null and peer is not null").distinct()


def khop_layers(edges: DataFrame, queries: DataFrame, direction: str = "out", work: Workspace | None = None) -> DataFrame:
    """``(req, hop, node)``: the nodes that each of ``queries(req, items, length, labels)`` reaches first at each hop.

    Without a ``work`` of the caller's the adjacency is deleted at the end and the layers stay, as the result reads them.
    """
    spark = edges.sparkSession
    own = work or Workspace(spark, "khop")
    limit = queries.agg(F.max("length")).first()[0] or 0
    labelled = not queries.where(F.size("labels") > 0).isEmpty()
    seeds = queries.select("req", "length", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.explode("items").alias("node")).distinct()
    frontier = own.put(seeds.select("req", "length", "labels", F.lit(0).alias("hop"), "node"), "layer0")
    layers = [frontier]
    if limit > 0:
        links = own.put(adjacency(edges, direction, labelled), "adjacency")
        for hop in range(1, limit + 1):
            step = frontier.where(F.col("length") >= hop).join(links, "node")
            if labelled:
                step = step.where((F.size("labels") == 0) | F.array_contains("labels", F.col("edge_label")))
            found = step.select("req", "length", "labels", F.col("peer").alias("node")).distinct()
            seen = layers[0]
            for layer in layers[1:]:
                seen = seen.unionByName(layer)
            fresh = found.join(seen.select("req", "node"), ["req", "node"], "left_anti")
            frontier = own.put(fresh.select("req", "length", "labels", F.lit(hop).alias("hop"), "node"), f"layer{hop}")
            layers.append(frontier)
            if frontier.isEmpty():
                break
        own.drop("adjacency")
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out.where("hop > 0").select("req", "hop", "node")


def with_label(layers: DataFrame, edges: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Only nodes that carry one of the node labels; the traversal itself was not restricted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("start_id").alias("node"), F.col("start_label").alias("label")), F.struct(F.col("end_id").alias("node"), F.col("end_label").alias("label")))).alias("e"))
    return layers.join(ends.where(F.col("e.label").isin(*labels)).select("e.node").distinct(), "node", "left_semi")


def counts(layers: DataFrame, queries: DataFrame, mode: str = "within") -> DataFrame:
    """``(req, count)`` of every query: all layers up to its length, or with ``exact`` the last one only."""
    if mode not in ("within", "exact"):
        raise ValueError(f"mode {mode!r}")
    used = layers
    if mode == "exact":
        used = layers.join(queries.select("req", "length"), "req").where("hop = length")
    got = used.groupBy("req").agg(F.count("*").alias("_n"))
    return queries.select("req").join(got, "req", "left").select("req", F.coalesce("_n", F.lit(0)).cast("long").alias("count"))


def counts_by_hop(layers: DataFrame, limit: int) -> DataFrame:
    """``(hop, new_nodes, within)`` for every hop from 1 to ``limit`` of a single query; a row per hop only."""
    from pyspark.sql import Window

    hops = layers.sparkSession.range(1, limit + 1).select(F.col("id").cast("int").alias("hop"))
    got = layers.groupBy("hop").agg(F.count("*").alias("_n"))
    rows = hops.join(got, "hop", "left").select("hop", F.coalesce("_n", F.lit(0)).cast("long").alias("new_nodes"))
    return rows.withColumn("within", F.sum("new_nodes").over(Window.orderBy("hop")))


def bitmap_count(ids: DataFrame, column: str = "id") -> DataFrame:
    """Distinct ids below 2**63 counted in compressed blocks of bits."""
    blocks = ids.groupBy(F.bitmap_bucket_number(column).alias("_b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(column))).alias("_n"))
    return blocks.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("count"))


def khop_count(edges: DataFrame, query: KHopQuery, direction: str = "out", mode: str = "within", end_labels: tuple[str, ...] = ()) -> int:
    """The count of one query."""
    asked = query.frame(edges.sparkSession)
    layers = khop_layers(edges, asked, direction)
    if end_labels:
        layers = with_label(layers, edges, end_labels)
    return counts(layers, asked, mode).first()["count"]
