"""Streams of edge lines and of requests; both forms keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.operators.service import answer, parse_queries, parse_requests
from hoplite.sources.lines import parsed


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """Edges of text files that appear below ``path``."""
    return parsed(spark.readStream.option("lineSep", "\n").text(path))


def query_stream(requests: DataFrame) -> DataFrame:
    """A stream of ``raw`` requests with path and query."""
    return parse_queries(parse_requests(requests))


def answer_stream(requests: DataFrame, edges: DataFrame, sink, **options):
    """Start answering a stream of ``(req, raw)``: each micro-batch traverses ``edges`` together and goes to
    ``sink(responses, batch number)``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(answer(batch, edges), number)

    return requests.where(F.col("raw").isNotNull()).writeStream.options(**options).foreachBatch(each).start()
