"""Toxicity by weak supervision.

Voters: one for each word and word beginning that a lexicon search over a labelled sample finds telling, one for a
fixed seed lexicon, some for patterns of writing, and the annotators, who vote on the documents that they
have judged. A voter fires or abstains. A generative model of the votes is fitted by expectation maximisation to judged and
unjudged documents alike: how often each voter fires under either class, how often the annotators say the class,
and how voters correlate within a class; correlated voters share their say. Its posteriors, not the labels, train a logistic
classifier on the (log) counts of the voters and of the lexicon voters together, which scores every text. It learns from the
judged documents: of the others, the model's rates and correlations profit.

The samples have about ``SAMPLE`` labelled and ``UNLABELLED`` other documents of up to ``SAMPLE_BYTES`` each, one text an id; texts above
``TRAIN_TEXT`` characters are represented by windows of them.

Defined results: null and empty texts fire no voter and get the score of such a text; without labels only the seed
lexicon and the patterns vote. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import fold, slices, small_batches, table, texts
from hoplite.llm.decontaminate import words_of
from hoplite.llm.labelled import labelled_sample, unlabelled_sample

SAMPLE, UNLABELLED, SAMPLE_BYTES, TRAIN_TEXT = 8_000, 4_000, 32 << 20, 1 << 16
#: Prior counts of the annotators being right and wrong.
RIGHT, WRONG = 29.0, 1.0
#: Lexicon voters at most, and the documents that must show one.
VOTERS, LEAST_DOCS = 600, 4
#: Lengths of word beginnings, in characters.
BEGINNINGS = (4, 5, 6)
#: English insults (fixed values).
SEED = frozenset(b"idiot moron stupid loser scum trash clown worthless pathetic disgusting dumb imbecile".split())
#: Patterns of writing; each is a voter.
PATTERNS = (rb"!{3,}", rb"\b(?:you|your|you're)\b", rb"\b[A-Z]{4,}\b", rb"[@#$%&*]{3,}")
#: Distinct words whose voters a worker remembers.
CACHE = 400_000


class Voters:
    """Words and beginnings with voter numbers; patterns and seed come after them."""

    def __init__(self, words: dict[bytes, int], starts: dict[bytes, int]):
        self.words, self.starts = words, starts
        self.count = len(words) + len(starts) + 1 + len(PATTERNS)
        self.compiled = [re.compile(p) for p in PATTERNS]
        self.seen: set[bytes] = set()
        self.telling: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.words, self.starts

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, word: bytes) -> None:
        hits = [self.words[word]] if word in self.words else []
        if self.starts:
            text = word.decode("utf-8", "replace")
            hits += [self.starts[s] for n in BEGINNINGS if len(text) >= n and (s := text[:n].encode()) in self.starts]
        if word in SEED:
            hits.append(self.count - 1 - len(PATTERNS))
        if hits:
            self.telling[word] = tuple(hits)

    def fire(self, text: bytes | None) -> dict[int, int]:
        """Voter number to how often it fires; under ``count`` the words for which any lexicon voter fires."""
        if not text:
            return {}
        found: Counter = Counter()
        for part in slices(text):
            words = words_of(part)
            distinct = set(words)
            if len(self.seen) > CACHE:
                self.seen, self.telling = set(), {}
            for w in distinct - self.seen:
                self._learn(w)
            self.seen |= distinct
            if hits := distinct & self.telling.keys():
                for w in words:
                    if w in hits:
                        found.update(self.telling[w])
                        found[self.count] += 1
        for i, p in enumerate(self.compiled):
            if p.search(text):
                found[self.count - len(PATTERNS) + i] = 1
        return found


def find_voters(sample: list[tuple[bytes, int]]) -> Voters:
    """Words and beginnings that occur in at least LEAST_DOCS toxic texts and hardly elsewhere."""
    seen, docs = set(), {0: 0, 1: 0}
    words = {0: Counter(), 1: Counter()}
    starts = {0: Counter(), 1: Counter()}
    for text, y in sample:
        if text in seen:  # copies tell nothing new
            continue
        seen.add(text)
        docs[y] += 1
        distinct = set(words_of(text))
        words[y].update(distinct)
        starts[y].update({t[:n] for t in (w.decode("utf-8", "replace") for w in distinct) for n in BEGINNINGS if len(t) > n})

    def telling(counts) -> list:
        found = []
        for w, a in counts[1].items():
            b = counts[0].get(w, 0)
            rate1, rate0 = (a + 0.5) / (docs[1] + 1), (b + 0.5) / (docs[0] + 1)
            if a >= LEAST_DOCS and rate1 >= 8 * rate0 and a >= 3 * b:
                gain = a * np.log(rate1 / rate0) + (docs[1] - a) * np.log((1 - rate1 + 1e-9) / (1 - rate0 + 1e-9))
                found.append((-gain, w))
        return [w for _, w in sorted(found)[: VOTERS // 2]]

    lexicon, begin = telling(words), telling(starts)
    return Voters({w: i for i, w in enumerate(lexicon)}, {w.encode(): i + len(lexicon) for i, w in enumerate(begin)})


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior of class 1 for each row of 0/1 ``votes``; ``labels`` (0, 1, or -1 where they abstain) are the annotators' votes.

    Each voter has a firing rate per class, the annotators a rate of saying the class; a voter's log-odds are divided by one plus its
    positive correlations with the other voters within the classes, so that voters that say the same are not counted twice.
    """
    if not len(votes):
        return np.zeros(0)
    p = np.where(labels >= 0, np.where(labels == 1, 0.95, 0.05), np.where(votes.sum(axis=1) > 0, 0.5, 0.1))
    say = np.ones(votes.shape[1])
    for step in range(rounds):
        w1, w0 = p.sum() + 1e-9, (1 - p).sum() + 1e-9
        t1, t0 = (p @ votes + 0.5) / (w1 + 1), ((1 - p) @ votes + 0.5) / (w0 + 1)
        # the annotators say 1 in class 1, and 1 in class 0
        said1 = (p[labels == 1].sum() + RIGHT) / (p[labels >= 0].sum() + RIGHT + WRONG)
        said0 = ((1 - p)[labels == 1].sum() + WRONG) / ((1 - p)[labels >= 0].sum() + RIGHT + WRONG)
        if step % 5 == 0:
            spread = np.zeros((votes.shape[1],) * 2)
            for w, t in ((p, t1), (1 - p, t0)):
                # the weighted scatter around the rates, without a second copy of the votes
                spread += ((votes * w[:, None].astype(votes.dtype)).T @ votes - w.sum() * np.outer(t, t) - np.outer(w @ votes - w.sum() * t, t) - np.outer(t, w @ votes - w.sum() * t)) / (w1 + w0)
            dev = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            r = np.clip(spread / dev[:, None] / dev[None, :], 0, 1)
            np.fill_diagonal(r, 0)
            r[r < 0.1] = 0  # sampling noise
            say = 1 / (1 + r.sum(axis=1))
        odds = np.log(w1 / w0) + votes @ (say * np.log(t1 / t0)) + (1 - votes) @ (say * np.log((1 - t1) / (1 - t0)))
        odds += np.where(labels == 1, np.log(said1 / said0), np.where(labels == 0, np.log((1 - said1) / (1 - said0)), 0))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression on soft labels, by Newton steps.

    The last column, the words that any lexicon voter knows, is hardly held back: what a voter alone adds must show in many texts.
    """
    x = np.c_[x, np.ones(len(x), x.dtype)]
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-2:] = 1e-2, 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of ``z`` that agrees with ``y`` most often; the middle of the widest gap among equally good ones."""
    values, inverse = np.unique(z, return_inverse=True)
    if len(values) < 2 or y.all() or not y.any():
        return 0.0
    gain = np.cumsum(np.bincount(inverse, np.where(y, -1, 1)))[:-1]  # right below the cut less wrong below it
    best = np.flatnonzero(gain == gain.max())
    at = best[np.argmax((values[1:] - values[:-1])[best])]
    return float((values[at] + values[at + 1]) / 2)


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def score(self, text: bytes | None) -> float:
        z = self.weights[-1] + sum(self.weights[v] * np.log1p(k) for v, k in self.voters.fire(text).items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(sample: list[tuple[bytes, int]], unlabelled: list[bytes] = ()) -> Model:
    voters = find_voters(sample)
    if not sample:  # the seed lexicon alone
        weights = np.zeros(voters.count + 2)
        weights[voters.count - 1 - len(PATTERNS)], weights[-1] = 3.0, -2.0
        return Model(voters, weights)
    rows = [*sample, *((t, -1) for t in unlabelled)]
    fired = np.zeros((len(rows), voters.count + 1), np.float32)
    for i, (text, _) in enumerate(rows):
        for v, k in voters.fire(text).items():
            fired[i, v] = k
    labels = np.array([y for _, y in rows])
    posterior = label_model((fired[:, :-1] > 0).astype(np.float32), labels)
    fired, judged = np.log1p(fired[: len(sample)]), posterior[: len(sample)]
    weights = logistic(fired, judged)
    weights[-1] -= best_cut(fired @ weights[:-1] + weights[-1], judged >= 0.5)
    return Model(voters, weights)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, TRAIN_TEXT, SAMPLE_BYTES)
    return train(sample, unlabelled_sample(docs, labels, "toxic", UNLABELLED, TRAIN_TEXT, SAMPLE_BYTES) if sample else [])


def scorer(model: Model, spark: SparkSession):
    """A column function: text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for t in texts(column)], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), scorer(fit(docs, labels), spark)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` whose score is below one half."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(fit(docs, labels), docs.sparkSession)("text") < 0.5)


QUERIES = {"op6_toxicity": op6_toxicity}
