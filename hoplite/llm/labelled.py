"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplite.llm.common import fold, sampled
from hoplite.plans.workspace import Workspace

#: Windows that a long text is represented by.
WINDOWS = 4


def _windows(text: Column, longest: int) -> Column:
    """A text of up to ``longest`` characters whole; of a longer one WINDOWS evenly spaced windows that have so many together."""
    size = longest // WINDOWS
    starts = [F.floor((F.length(text) - size) * i / (WINDOWS - 1)).cast("int") + 1 for i in range(WINDOWS)]
    return F.when(F.length(text) <= longest, text).otherwise(F.concat_ws("\n", *(F.substring(text, s, F.lit(size)) for s in starts)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, longest: int, most_bytes: int, folds: int = 5, held: int = 0) -> list[tuple[bytes, int]]:
    """``(text, y)`` of about ``rows`` labelled documents outside the held-out fold, with up to ``most_bytes`` of text together, sorted.

    Ids are chosen by hash from ``labels`` alone, one row each, so the side that is broadcast has a known size and the
    documents are not shuffled. Of several labels of an id the largest counts, of several texts the least; partial
    aggregates leave one row an id and task. Texts of any length teach, long ones by windows.
    """
    known = _judged(labels, column).where(fold("doc_id", folds) != held).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    with Workspace(docs.sparkSession, "labelled") as work:
        known = work.put(known, "known")
        known = sampled(known, F.col("doc_id"), rows, known.count())
        found = docs.where(F.col("text").isNotNull()).select("doc_id", _windows(F.col("text"), longest).alias("text")).join(F.broadcast(known), "doc_id")
        return _fetched(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), most_bytes, work)


def unlabelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, longest: int, most_bytes: int, folds: int = 5, held: int = 0) -> list[bytes]:
    """Texts of about ``rows`` documents outside the held-out fold that no label judges, one for each id, under the same bounds."""
    pool = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).select("doc_id", _windows(F.col("text"), longest).alias("text"))
    with Workspace(docs.sparkSession, "unlabelled") as work:
        chosen = work.put(sampled(pool, F.col("doc_id"), rows, docs.count()).groupBy("doc_id").agg(F.min("text").alias("text")), "chosen")
        free = chosen.join(_judged(labels, column).select("doc_id"), "doc_id", "left_anti")
        return [t for t, _ in _fetched(free.withColumn("y", F.lit(-1)), most_bytes, work)]


def _judged(labels: DataFrame, column: str) -> DataFrame:
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", column)


def _fetched(one: DataFrame, most_bytes: int, work: Workspace) -> list[tuple[bytes, int]]:
    """``(text, y)`` of ``one(doc_id, text, y)`` in the order of the ids' hashes until the bytes are reached, sorted."""
    sample = work.put(one.select(F.xxhash64("doc_id").alias("h"), "text", "y"), "sample")
    total, last = 0, None
    for r in sample.select("h", F.octet_length("text").alias("n")).orderBy("h").toLocalIterator():
        if total and total + r.n > most_bytes:
            break
        total, last = total + r.n, r.h
    if last is None:
        return []
    return sorted((r.text.encode("utf-8", "surrogatepass"), r.y) for r in sample.where(F.col("h") <= last).toLocalIterator())
