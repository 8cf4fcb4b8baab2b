"""Command line: build a graph from edge text, look nodes up, answer requests from files or on a port.

    python -m hoplite build EDGES PATH [--header] [--fields 0 3]
    python -m hoplite lookup PATH TEXT...
    python -m hoplite answer EDGES REQUESTS [--header]
    python -m hoplite serve EDGES [--port 8080] [--header]

Under spark-submit the session's settings are those of the cluster.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.operators import dictionary, service
from hoplite.plans.workspace import Workspace, release
from hoplite.sources import lines
from hoplite.sources.store import Graph
from hoplite.streaming.server import RequestServer


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="hoplite")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="write a graph's nodes, edges and offsets")
    build.add_argument("edges")
    build.add_argument("path")
    build.add_argument("--fields", nargs=2, type=int, default=(0, 3), help="positions of source and target")
    lookup = commands.add_parser("lookup", help="id, degrees and neighbours of nodes by their text")
    lookup.add_argument("path")
    lookup.add_argument("text", nargs="+")
    answer = commands.add_parser("answer", help="a response per file of requests")
    answer.add_argument("edges")
    answer.add_argument("requests")
    serve = commands.add_parser("serve", help="answer requests on a port, one after the other")
    serve.add_argument("edges")
    serve.add_argument("--port", type=int, default=8080)
    for command in (build, answer, serve):
        command.add_argument("--header", action="store_true", help="leave the first line of each file out")
    return parser.parse_args(argv)


def build(spark: SparkSession, edges: str, path: str, fields: tuple[int, int] = (0, 3), header: bool = False) -> Graph:
    found = lines.endpoints(lines.read_lines(spark, edges, header), *fields)
    graph = Graph.build(found, Workspace(spark, "build"), "src_str", "dst_str")
    graph.save(path)
    return Graph.load(spark, path)


def lookup(spark: SparkSession, path: str, text: list[str]) -> list[dict]:
    graph = Graph.load(spark, path)
    probes = spark.createDataFrame([(t,) for t in text], "str_id string")
    found = {r.str_id: r.id for r in dictionary.string_to_id(probes, graph.nodes).collect()}
    return [{"node": t, "id": found[t], "out": graph.out_neighbours(found[t]), "in": graph.in_neighbours(found[t])} for t in text]


def answers(spark: SparkSession, edges: str, requests: str, header: bool = False) -> DataFrame:
    """A response per file below ``requests``, in the order of the files' names."""
    raw = spark.read.text(requests, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    numbered = dictionary.dense_ids(raw.select("file").distinct(), "file", "req", Workspace(spark, "requests"), "files").join(raw, "file")
    return service.answer(numbered.select("req", "raw"), lines.read_edges(spark, edges, header)).orderBy("req")


def main(argv: list[str] | None = None) -> int:
    a = _arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("hoplite").getOrCreate()
    try:
        if a.command == "build":
            g = build(spark, a.edges, a.path, tuple(a.fields), a.header)
            print(json.dumps({"nodes": g.node_count(), "edges": g.edge_count()}))
        elif a.command == "lookup":
            for row in lookup(spark, a.path, a.text):
                print(json.dumps(row))
        elif a.command == "answer":
            for r in answers(spark, a.edges, a.requests, a.header).collect():
                print(json.dumps({"req": r.req, "path": r.path, "count": r["count"]}))
        else:
            with RequestServer(lines.read_edges(spark, a.edges, a.header).persist(), a.port) as server:
                print(f"port {server.port}", flush=True)
                server.serve_forever()
    finally:
        release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
