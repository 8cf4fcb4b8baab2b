"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are runs of three character classes, shares of repeated words and its
compressibility. Term weights (log counts times inverse document frequency, unit length) of a
labelled sample are reduced by a singular value decomposition to ``RANK`` latent dimensions. The
sample's vectors, about ``SAMPLE`` of one text an id and up to ``SAMPLE_BYTES`` of text (texts above ``TRAIN_TEXT`` characters by windows), are broadcast; each document is projected, its cosines with all of
them are computed exactly, batch by batch, and the ``NEIGHBOURS`` nearest vote with their similarity as weight.

Defined results: null and empty texts have no terms and get the sample's share of label 1; without labels every score is
one half. Ties in similarity go to the earlier sample vector; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import fold, slices, small_batches, table, texts, word_hashes
from hoplite.llm.labelled import labelled_sample

SAMPLE, SAMPLE_BYTES, TRAIN_TEXT = 3_000, 48 << 20, 1 << 16
RANK, NEIGHBOURS, THRESHOLD = 32, 15, 0.3

_CLASSES = 12


def _classes() -> np.ndarray:
    """Character class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 full stop, 6 comma, 7 !?, 8 bar, 9 symbol, 10 other ASCII, 11 beyond ASCII."""
    out = np.full(256, 10, np.int64)
    out[128:] = 11
    for chars, c in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r", 4), (".", 5), (",", 6), ("!?", 7), ("|", 8), ("#$%&*@^~", 9)):
        out[list(chars.encode())] = c
    return out


CLASS_OF = _classes().astype(np.uint8)
BLANK = CLASS_OF[[32]]
#: Characters whose runs are counted at a time.
SPAN = 1 << 20
_GRAMS = _CLASSES**3
_LEVELS = 10
TERMS = _GRAMS + 4 * _LEVELS


def _kinds(parts) -> tuple[int, int, int]:
    """How many pieces lists of them hold, how many different ones, and how many are equal to the one before; long texts by their hashes."""
    held: list[np.ndarray] = []
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return len(first), len(set(first)), sum(map(bytes.__eq__, first, first[1:]))
    for part in chain((first, second), parts):
        held.append(word_hashes(part))
    h = np.concatenate(held)
    return len(h), len(np.unique(h)), int(np.count_nonzero(h[1:] == h[:-1]))


def terms(text: bytes | None) -> np.ndarray | None:
    """Term counts of a text; None if it has none."""
    if not text or not text.strip():
        return None
    c = np.concatenate([BLANK, CLASS_OF[np.frombuffer(text, np.uint8)], BLANK])
    out = np.zeros(TERMS, np.float32)
    runs = np.zeros(_GRAMS, np.int64)
    for lo in range(0, len(c) - 2, SPAN):
        x = c[lo : lo + SPAN + 2].astype(np.int16)
        runs += np.bincount(x[:-2] * (_CLASSES * _CLASSES) + x[1:-1] * _CLASSES + x[2:], minlength=_GRAMS)
    out[:_GRAMS] = runs
    n, distinct, repeated = _kinds(part.lower().split() for part in slices(text))
    lines, distinct_lines, _ = _kinds(part.removesuffix(b"\n").split(b"\n") for part in slices(text + b"\n", b"\n"))
    z = zlib.compressobj(1)
    packed = sum(len(z.compress(part)) for part in slices(text)) + len(z.flush())
    shares = (distinct / n, repeated / n, distinct_lines / lines, min(1.0, packed / len(text)))
    strength = 0.5 * len(c) ** 0.5  # the shares weigh about as much as common runs do
    for i, s in enumerate(shares):
        x = min(s, 0.999) * _LEVELS
        k, f = int(x), x - int(x)
        out[_GRAMS + i * _LEVELS + k] += strength * (1 - f)
        out[_GRAMS + i * _LEVELS + min(k + 1, _LEVELS - 1)] += strength * f
    return out


class Model:
    def __init__(self, rows: np.ndarray, y: np.ndarray):
        self.y = y.astype(np.float32)
        self.share = float(y.mean()) if len(y) else 0.5
        if not len(rows):
            return
        df = np.count_nonzero(rows, axis=0)
        self.idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 0.1
        x = self._weighted(rows)
        self.keep = np.flatnonzero(df)
        _, vectors = np.linalg.eigh(x[:, self.keep].T @ x[:, self.keep])
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :RANK].astype(np.float32))
        self.points = self._unit(x[:, self.keep] @ self.axes)

    def _weighted(self, rows: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(rows) * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, raw: list[bytes | None]) -> list[float]:
        out = [self.share] * len(raw)
        if not len(self.y):
            return out
        for lo in range(0, len(raw), 256):
            found = [(i, t) for i in range(lo, min(lo + 256, len(raw))) if (t := terms(raw[i])) is not None]
            if not found:
                continue
            x = self._unit(self._weighted(np.stack([t for _, t in found]))[:, self.keep] @ self.axes)
            cosine = x @ self.points.T
            k = min(NEIGHBOURS, len(self.y))
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if k == len(self.y) else self._nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** 8
            votes = (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)
            for (i, _), v in zip(found, votes.tolist(), strict=True):
                out[i] = min(1.0, max(0.0, v))
        return out

    @staticmethod
    def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
        """Columns of the k largest of each row; of equal ones the first."""
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        above = cosine > least
        room = k - above.sum(axis=1, keepdims=True)
        ties = cosine == least
        chosen = above | (ties & (np.cumsum(ties, axis=1) <= room))
        return np.nonzero(chosen)[1].reshape(len(cosine), k)


def train(sample: list[tuple[bytes, int]]) -> Model:
    rows = [(t, y) for text, y in sample if (t := terms(text)) is not None]
    return Model(np.stack([t for t, _ in rows]) if rows else np.zeros((0, TERMS)), np.array([y for _, y in rows], np.float32))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_sample(docs, labels, "quality", SAMPLE, TRAIN_TEXT, SAMPLE_BYTES))


def scorer(model: Model, spark: SparkSession):
    """A column function: text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts(column)), pa.float64())

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), scorer(fit(docs, labels), spark)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(fit(docs, labels), docs.sparkSession)("text") >= THRESHOLD)


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
