"""Corpus preparation in stages; each works on all that its predecessor kept.

1. toxicity: documents that the classifier rejects go
2. quality: documents that the neighbours' vote rejects go
3. near duplicates: one document of each group stays, the one with the smallest id
4. decontamination: documents that hold a window of a benchmark item go
5. pieces: the remaining documents as SentencePiece ids, decoded again to say whether that gives the text back

Stages 1 to 4 return the columns of ``documents``; the last returns ``doc_id, n_pieces, piece_ids, round_trip``.
A stage's result is written as Parquet and read again as the next one's input.

Defined results: a null or empty text is not toxic, has the sample's share as quality, no copies, no windows and null or no pieces; rows
that repeat an id are judged each by its text; an empty table gives an empty one at every stage; further columns of the
documents, whatever their names, are kept up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm import decontaminate, ngram_join, quality, sentencepiece_codec, toxicity
from hoplite.llm.common import table
from hoplite.plans.workspace import Workspace, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encoded(docs.select("doc_id", "text"), check=True)
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifiers and the segmentation can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with scope(spark):  # a stage's own tables go once its result is written
            docs = work.put(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            work.drop(f"stage{i - 1}")
    return docs
