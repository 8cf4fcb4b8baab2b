"""Graphs at rest: Parquet directories ``nodes``, ``edges`` and ``offsets`` below one path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.operators import adjacency, dictionary
from hoplite.plans.workspace import Workspace
from hoplite.schema import ENCODED, NODES, OFFSETS


@dataclass
class Graph:
    """A dictionary and encoded edges, usable at once after building."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, edges: DataFrame, work: Workspace, src: str = "start_id", dst: str = "end_id") -> "Graph":
        nodes = dictionary.node_dictionary(edges.select(F.col(src).alias("start_id"), F.col(dst).alias("end_id")), work)
        return cls(nodes, work.put(dictionary.encoded_edges(edges, nodes, src=src, dst=dst), "encoded"))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def out_degree(self, node: int) -> int:
        return self._one(node, adjacency.degree_lookup, "out", "degree")

    def in_degree(self, node: int) -> int:
        return self._one(node, adjacency.degree_lookup, "in", "degree")

    def out_neighbours(self, node: int) -> list[int]:
        return self._one(node, adjacency.neighbour_lookup, "out", "list")

    def in_neighbours(self, node: int) -> list[int]:
        return self._one(node, adjacency.neighbour_lookup, "in", "list")

    def string_to_id(self, text: str) -> int:
        return dictionary.string_to_id(self.nodes.sparkSession.createDataFrame([(text,)], "str_id string"), self.nodes).first()["id"]

    def id_to_string(self, node: int) -> str:
        return dictionary.id_to_string(self.nodes.sparkSession.createDataFrame([(node,)], "id long"), self.nodes).first()["str_id"]

    def _one(self, node: int, lookup, direction: str, column: str):
        return lookup(self.nodes.sparkSession.createDataFrame([(node,)], "id long"), self.edges, direction).first()[column]

    def keep(self) -> "Graph":
        """Hold both tables in memory, spilling to disk."""
        self.nodes, self.edges = self.nodes.persist(), self.edges.persist()
        return self

    def release(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def save(self, path: str) -> None:
        """Edges are clustered and ordered by source, so that row groups can be skipped by it."""
        self.nodes.select(*NODES.names).write.parquet(f"{path}/nodes")
        adjacency.clustered_edges(self.edges.select(*ENCODED.names)).write.parquet(f"{path}/edges")
        for direction in ("out", "in"):
            adjacency.csr_offsets(self.nodes, self.edges, direction).write.parquet(f"{path}/offsets_{direction}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Graph":
        """A saved graph, an empty one included."""
        return cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(ENCODED).parquet(f"{path}/edges"))


def load_offsets(spark: SparkSession, path: str, direction: str = "out") -> DataFrame:
    return spark.read.schema(OFFSETS).parquet(f"{path}/offsets_{direction}")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(path, content)``; an absent path raises."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
