"""Language identification by prediction by partial matching.

For each language a context tree of bytes up to depth ``DEPTH`` holds, for
every context, how often which byte followed. A byte costs ``-log2(c / (n + d))`` in
the longest context that has seen it, and each longer context passed on the way costs its escape
``d / (n + d)``, with ``n`` bytes and ``d`` distinct ones seen there; below the empty
context all symbols are alike. The trees are frozen after training and compiled to tables that all languages share: for
depths 2 and 3, a bitmap of the symbols that any language has seen in a context, and one row of costs, a cell per language,
for each bit that is set; other symbols take the context's escapes and the next shorter context. Nothing that the trees
have counted is left out. The language with the least total code length wins; the score is its posterior under equal priors.

Trees learn from a sample of distinct texts of each language, by hash, that ends with the text that reaches
``TRAIN_BYTES``; every language with a text has at least one. A text brings its first ``TRAIN_TEXT`` bytes, or more where a
language has too few texts to reach ``TRAIN_BYTES`` so. The tables grow with the distinct runs of four bytes in all samples times the number
of languages; should they pass ``CELLS`` cells of 4 bytes (some hundred languages of mixed scripts do), the trees learn from the
first half of every text of the sample, or a quarter, and so on.

Defined results: null texts and texts without a letter are ``und`` with score 0; if there is nothing
to learn from, all are ``und``. Equal code lengths go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import fold, small_batches, table
from hoplite.plans.workspace import Workspace

DEPTH = 3
#: Bytes of training text per language, and what the sample takes of a long text.
TRAIN_BYTES, TRAIN_TEXT = 400_000, 1 << 16
#: Cells of the compiled tables, 4 bytes each.
CELLS = 50_000_000
#: Bytes scored at a time.
SLICE = 1 << 18


class Level:
    """Contexts of one depth: which symbols any language has seen there, what these cost in each language, and the escapes."""

    def __init__(self, size: int, depth: int, counts: list[tuple[np.ndarray, np.ndarray]], below):
        """``counts`` has, for each language, the codes of (context, symbol) and their numbers; ``below(contexts, symbols)`` the costs one level down."""
        codes = np.unique(np.concatenate([c for c, _ in counts]))
        contexts, row = np.unique(codes // size, return_inverse=True)
        symbols = codes % size
        self.size, self.words = size, -(-size // 64)
        self.row = np.full(size**depth, -1, np.int32)
        self.row[contexts] = np.arange(len(contexts))
        bits = np.zeros((len(contexts), size + -size % 64), bool)
        bits[row, symbols] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        self.base = np.r_[0, np.cumsum(np.bitwise_count(self.bits))[:-1]].astype(np.int32)
        self.escape = np.zeros((len(contexts), len(counts)), np.float32)
        self.cost = below(contexts % size ** (depth - 1), row, symbols)
        for i, (code, c) in enumerate(counts):
            at = np.searchsorted(contexts, code // size)
            n = np.bincount(at, weights=c, minlength=len(contexts))
            d = np.bincount(at, minlength=len(contexts))
            self.escape[:, i] = -np.log2(np.where(n > 0, d / np.maximum(n + d, 1), 1.0))
            self.cost[:, i] += self.escape[row, i]
            self.cost[np.searchsorted(codes, code), i] = -np.log2(c / (n + d)[at])

    def find(self, contexts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of ``escape`` of each context, and row of ``cost`` of each pair; -1 where there is none."""
        row = self.row[contexts]
        word = np.maximum(row, 0) * np.int64(self.words) + (symbols >> 6)
        bits, shift = self.bits[word], (symbols & 63).astype(np.uint64)
        seen = (row >= 0) & (bits >> shift & np.uint64(1) != 0)
        place = self.base[word] + np.bitwise_count(bits & ((np.uint64(1) << shift) - np.uint64(1)))
        return row, np.where(seen, place, -1)

    @property
    def cells(self) -> int:
        return self.cost.size + self.escape.size


class ContextTrees:
    """Frozen statistics of all languages, compiled."""

    def __init__(self, samples: dict[str, list[bytes]], cells: int = CELLS):
        self.langs = sorted(samples)
        seen = np.zeros(256, np.int64)
        for texts in samples.values():
            for t in texts:
                seen += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        # symbol 0 stands for "before the text", 1 for bytes never seen in training
        self.symbol = np.ones(256, np.int64)
        known = np.flatnonzero(seen)
        self.symbol[known] = np.arange(len(known)) + 2
        self.size = len(known) + 2
        part = 1
        while True:
            counts = [self._counted(samples[lang], part) for lang in self.langs]
            distinct = sum(len(np.unique(np.concatenate([c[k][0] for c in counts]))) for k in (2, 3))
            if 2 * distinct * len(self.langs) <= cells or part > 1 << 20:  # costs and escapes
                break
            part *= 2
        empty = np.stack([self._costs(c[0], 1, np.full((1, self.size), 8.0)) for c in counts], axis=-1)
        one = [self._costs(c[1], self.size, np.repeat(empty[:, :, i], self.size, axis=0)) for i, c in enumerate(counts)]
        #: costs of (symbol before, symbol), dense
        self.one = np.stack(one, axis=-1).reshape(self.size**2, -1).astype(np.float32)
        a = self.size
        self.two = Level(a, 2, [c[2] for c in counts], lambda shorter, row, symbols: self.one[shorter[row] * a + symbols])
        self.three = Level(a, 3, [c[3] for c in counts], lambda shorter, row, symbols: self._from_two(shorter[row], symbols))

    def _counted(self, texts: list[bytes], part: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth, codes of (context, next symbol) with their counts."""
        cut = [t[: max(1, len(t) // part)] for t in texts]
        return [self._counts(cut, k) for k in range(DEPTH + 1)]

    def _counts(self, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (k symbols, next symbol) with their counts."""
        a, found = self.size, [np.empty(0, np.int64)]
        for t in texts:
            s = np.concatenate([np.zeros(k, np.int64), self.symbol[np.frombuffer(t, np.uint8)]])
            code = np.zeros(len(s) - k, np.int64)
            for i in range(k + 1):
                code = code * a + s[i : i + len(code)]
            found.append(code)
        return np.unique(np.concatenate(found), return_counts=True)

    def _costs(self, counts: tuple[np.ndarray, np.ndarray], contexts: int, shorter: np.ndarray) -> np.ndarray:
        """Costs (context, symbol) of one language: what the context has seen, else its escape and the cost in the shorter context."""
        codes, c = counts
        at, symbol = codes // self.size, codes % self.size
        n = np.bincount(at, weights=c, minlength=contexts)
        d = np.bincount(at, minlength=contexts)
        out = shorter - np.log2(np.where(n > 0, d / np.maximum(n + d, 1), 1.0))[:, None]
        out[at, symbol] = -np.log2(c / (n + d)[at])
        return out

    def _from_two(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Costs of symbols behind contexts of two."""
        row, place = self.two.find(contexts, symbols)
        out = self.two.cost[np.maximum(place, 0)]
        miss = np.flatnonzero(place < 0)
        if len(miss):
            r = row[miss]
            out[miss] = self.one[contexts[miss] % self.size * self.size + symbols[miss]] + np.where(r >= 0, 1, 0).astype(np.float32)[:, None] * self.two.escape[np.maximum(r, 0)]
        return out

    def _from_three(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        row, place = self.three.find(contexts, symbols)
        out = self.three.cost[np.maximum(place, 0)]
        miss = np.flatnonzero(place < 0)
        if len(miss):
            r = row[miss]
            out[miss] = self._from_two(contexts[miss] % self.size**2, symbols[miss]) + np.where(r >= 0, 1, 0).astype(np.float32)[:, None] * self.three.escape[np.maximum(r, 0)]
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits per (text, language) of the texts that lie in ``data`` between ``offsets``."""
        a, out = self.size, np.zeros((len(offsets) - 1, len(self.langs)))
        for lo in range(int(offsets[0]), int(offsets[-1]), SLICE):
            hi = min(lo + SLICE, int(offsets[-1]))
            back = max(lo - DEPTH, int(offsets[0]))
            s = self.symbol[data[back:hi]]
            n = hi - lo
            past = []
            for k in range(1, DEPTH + 1):
                x = np.zeros(n, np.int64)
                got = s[max(0, lo - back - k) : len(s) - k]
                x[n - len(got) :] = got
                past.append(x)
            first, last = np.searchsorted(offsets, lo, "left"), np.searchsorted(offsets, hi, "left")
            starts = offsets[first:last] - lo
            for k in range(1, DEPTH + 1):
                for j in range(k):
                    p = starts + j
                    past[k - 1][p[p < n]] = 0
            # a text that began just before the slice still has its first places in it
            if first > 0:
                for k in range(1, DEPTH + 1):
                    for j in range(k):
                        p = offsets[max(0, first - DEPTH) : first] + j - lo
                        past[k - 1][p[(p >= 0) & (p < n)]] = 0
            two = past[1] * a + past[0]
            cost = self._from_three(past[2] * a * a + two, s[lo - back :])
            inner = offsets[(offsets > lo) & (offsets < hi)] - lo
            cuts = np.unique(np.r_[0, inner])
            sums = np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
            owners = np.searchsorted(offsets, cuts + lo, "right") - 1
            np.add.at(out, owners, sums)
        return out


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predictor(model: ContextTrees | None, spark: SparkSession):
    """A column function: text to ``struct(lang, score)``."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        trees = shared.value
        raw = column.cast(pa.binary()).to_pylist()
        names, scores = ["und"] * len(raw), [0.0] * len(raw)
        if trees is not None and raw:
            lens = np.array([len(t) if t else 0 for t in raw], np.int64)
            offsets = np.r_[0, np.cumsum(lens)]
            bits = trees.code_lengths(np.frombuffer(b"".join(t or b"" for t in raw), np.uint8), offsets)
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            for i, t in enumerate(raw):
                if t and _has_letter(t):
                    names[i], scores[i] = trees.langs[best[i]], float(score[i])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def _chosen(keys: DataFrame) -> list[tuple[str, int, int]]:
    """``(lang, h, bytes to take)`` from ``keys(lang, h, b)``: each language's distinct texts by hash until TRAIN_BYTES are reached."""
    count = keys.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least("b", F.lit(TRAIN_TEXT))).alias("b")).collect()
    take = {r.lang: max(TRAIN_TEXT, -(-TRAIN_BYTES // r.n)) for r in count}
    # keys up to a hash that should suffice for four samples, a higher one where they do not
    share = {r.lang: min(1.0, 4 * TRAIN_BYTES / r.b) for r in count}
    chosen = []
    while share:
        bound: Column = F.lit(0)
        for lang, x in share.items():
            bound = F.when(F.col("lang") == lang, F.lit(int(x * (1 << 30)))).otherwise(bound)
        near = keys.where(F.col("lang").isin(list(share)) & (F.pmod("h", F.lit(1 << 30)) < bound)).collect()
        found: dict[str, list[tuple[int, int]]] = {lang: [] for lang in share}
        for r in near:
            found[r.lang].append((r.h, min(r.b, take[r.lang])))
        for lang, texts in found.items():
            if share[lang] < 1 and sum(b for _, b in texts) < TRAIN_BYTES:
                share[lang] = min(1.0, share[lang] * 4)
                continue
            del share[lang]
            got = 0
            for h, b in sorted(texts, key=lambda x: (x[0] % (1 << 30), x[0])):
                if got >= TRAIN_BYTES:
                    break
                chosen.append((lang, h, take[lang]))
                got += b
    return chosen


def train(labelled: DataFrame) -> ContextTrees | None:
    """Trees from ``labelled(text, lang)``: distinct texts of every language, chosen by hash, about TRAIN_BYTES per language."""
    spark = labelled.sparkSession
    usable = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).withColumn("h", F.xxhash64("text"))
    with Workspace(spark, "langid") as work:
        chosen = _chosen(work.put(usable.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("b")), "keys"))
    if not chosen:
        return None
    picked = spark.createDataFrame(chosen, "lang string, h long, take int")
    texts = usable.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", F.expr("substring(cast(text as binary), 1, take)").alias("text"))
    samples: dict[str, list[bytes]] = {lang: [] for lang, _, _ in chosen}
    for r in texts.dropDuplicates(["lang", "h"]).toLocalIterator():
        samples[r.lang].append(bytes(r.text))
    return ContextTrees(samples)


def identify(docs: DataFrame, key: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """Languages of all ``docs``, learnt from those whose fold is not ``held``: ``doc_id, held_out, lang_pred, score``."""
    spark = docs.sparkSession
    small_batches(spark)
    model = train(docs.where(fold(key, folds) != held).select("text", "lang"))
    out = docs.select(key, (fold(key, folds) == held).alias("held_out"), predictor(model, spark)("text").alias("p"))
    return out.select(key, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op4_language_id": op4_language_id}
