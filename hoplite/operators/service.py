"""Requests and responses as DataFrames; sockets stay outside.

Malformed input gives nulls (and a count of 0), never an exception. The query is the JSON object
``{"items": [...], "length": n, "labels": [...]}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplite.operators.traversal import counts, khop_layers
from hoplite.plans.workspace import Workspace
from hoplite.schema import QUERY

BREAK = "\r\n\r\n"
#: What precedes the count in a response (fixed value).
HEAD = 'HTTP/1.1 200 OK\r\nContent-Type: application/json\r\n\r\n{"count":'
#: Characters in front of the path, the method and a blank.
METHOD = 5


def path_of(raw: Column) -> Column:
    rest = F.substring(raw, METHOD + 1, F.length(raw))
    return F.when(F.instr(rest, " ") > 0, F.substring_index(rest, " ", 1))


def body_of(raw: Column) -> Column:
    """From the blank line on, which is kept."""
    at = F.instr(raw, BREAK)
    return F.when(at > 0, F.substring(raw, at, F.length(raw)))


def parse_requests(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """``requests`` with ``path`` and ``body``."""
    return requests.withColumns({"path": path_of(F.col(raw)), "body": body_of(F.col(raw))})


def parse_queries(requests: DataFrame, body: str = "body") -> DataFrame:
    """``requests`` with ``items``, ``length`` and ``labels`` from the JSON body."""
    q = F.from_json(F.trim(F.regexp_replace(body, r"^\s+", "")), QUERY)
    out = requests.withColumn("_q", q)
    return out.select(*requests.columns, "_q.items", "_q.length", "_q.labels")


def json_response(count: Column) -> Column:
    return F.to_json(F.struct(count.cast("long").alias("count")))


def http_response(count: Column) -> Column:
    return F.concat(F.lit(HEAD), count.cast("string"), F.lit("}"))


def answer(requests: DataFrame, edges: DataFrame, direction: str = "out", work: Workspace | None = None) -> DataFrame:
    """``requests(req, raw)`` to ``(req, path, count, response)``; all requests traverse together, a hop at a time."""
    queries = parse_queries(parse_requests(requests)).select("req", "path", "items", "length", "labels")
    asked = queries.select("req", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("length", F.lit(0)).alias("length"), "labels")
    got = counts(khop_layers(edges, asked, direction, work), asked)
    return queries.select("req", "path").join(got, "req").withColumn("response", http_response(F.col("count")))
