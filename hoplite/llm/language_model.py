"""Scoring by a Brown class-based bigram model.

``log10 P(text) = sum log10 P(class | previous class) + log10 P(word | class)``, with the end of a text as
a token of its own. Everything is counted over the whole training corpus:

1. words: one aggregation of per-task partial counts keyed by a 64-bit hash of the word;
2. contexts: the ``OWN`` most frequent words are types of their own, every other word belongs to a type that its last two bytes choose
   among ``ENDINGS``. For each type the types behind it are counted, and for each word without a type of its own the types on both
   sides, as one row a word. Partial counts of words that many tasks hold are added in two steps;
3. exchange: types exchange classes, the most frequent first, until no round raises the bigram likelihood;
4. exchange of all other words, whatever their number: in rounds, every word goes to the class under which its counts of
   neighbours' classes are most likely, given the class bigrams of the round before, and these are summed anew, until the
   likelihood rises no more. Only words that no training text holds keep the class of their ending;
5. class bigrams: counted over the final classes of all words.

``OWN`` is bounded by the memory of a dense matrix of type bigrams, no class of any word is. The texts are read
once for each of steps 1, 2 and 5. In the last, words that occur often (at most ``COMMON`` of them, so a table of known size is broadcast) are
classed and counted in place; the others, each rare by construction, are joined with the word table by a shuffle,
and the bigrams that they are part of are resolved per text.

Defined results: a null text is empty and consists of its end; each row of ``docs`` gives one row; without training
texts all counts are 0 and ``base_score`` and ``score`` are those of the smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import Words, fold, small_batches, table
from hoplite.plans.workspace import Workspace

#: Words scored in place, at most; those above are told by a histogram of counts.
COMMON = 150_000
#: Types of their own, types of word endings, classes.
OWN, ENDINGS, CLASSES = 2047, 256, 128
#: The share of the likelihood that a round must gain for another one, and rounds in any case no more than these.
GAIN, ROUNDS = 1e-5, 50
#: Additive smoothing of emissions and of transitions.
EMIT, MOVE = 0.1, 0.5
#: Distinct words that a task counts before it passes its counts on; neighbours that it holds before it counts them.
FLUSH, SIDES = 2_000_000, 4_000_000
#: Rows of contexts that a task hands over at a time.
OUT_ROWS = 1 << 16
#: First places of the counts of a common word or type.
SALT = 16
#: A context and how often it occurs.
ENTRY = np.dtype([("code", "<u2"), ("n", "<u4")])
MOST = np.iinfo(np.uint32).max


def endings(words: Words) -> np.ndarray:
    """The ending type of each word."""
    last = words.starts + words.sizes - 1
    one = words.data[last].astype(np.int64)
    two = np.where(words.sizes > 1, words.data[np.maximum(last - 1, 0)], 0).astype(np.int64)
    return (one * 31 + two * 131) % ENDINGS


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (hash, count)."""
    held = np.empty(0, np.uint64), np.empty(0, np.int64)
    batch_of = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["h", "c"])
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([held[0], *(x for x, _ in waiting)])
        u, inverse = np.unique(h, return_inverse=True)
        return u, np.bincount(inverse, np.concatenate([held[1], *(c for _, c in waiting)]), len(u)).astype(np.int64)

    for batch in batches:
        waiting.append(np.unique(Words(batch.column(0)).hashes, return_counts=True))
        if sum(len(x) for x, _ in waiting) > FLUSH // 2:
            held = merged()
            waiting = []
            if len(held[0]) > FLUSH:
                yield batch_of(held)
                held = np.empty(0, np.uint64), np.empty(0, np.int64)
    held = merged()
    if len(held[0]):
        yield batch_of(held)


class Types:
    """Type numbers: own types of frequent words, then endings, then the end of a text."""

    def __init__(self, own: np.ndarray):
        self.own = np.sort(own)
        self.count = len(own) + ENDINGS + 1
        self.end = self.count - 1

    def of(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        own, at = _among(hashes, self.own)
        return np.where(own, at, len(self.own) + ending)


def in_sequence(words: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of the words with ``end`` behind each text, and the words' places in that."""
    texts = len(words.bounds) - 1
    place = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(words.bounds))
    out = np.full(len(words) + texts, end, values.dtype)
    out[place] = values
    return out, place


# rows (kind, h, salt, sides): kind 0 holds the types behind type h, kind 1 the types around word h, the ones behind it moved by the number of types

_SIDES = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("salt", pa.int32()), ("sides", pa.binary())])


def _blobs(entries: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``entries`` as binary values that end at ``ends``."""
    offsets = np.r_[0, ends].astype(np.int32) * ENTRY.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of binary values, and how many each has."""
    wide = pa.types.is_large_binary(column.type)
    _, places, values = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values else np.empty(0, np.uint8)
    return raw.view(ENTRY), np.diff(at) // ENTRY.itemsize


def _added(group: np.ndarray, code: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of groups numbered from 0, equal ones added, each for one if ``n`` is None; and where each group ends."""
    key = group * np.int64(1 << 16)
    key += code
    if n is None:
        key.sort()  # in place: nothing as long as the input is held beside it
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    out = np.empty(len(first), ENTRY)
    if len(key):
        out["n"] = np.minimum(np.diff(np.r_[first, len(key)]) if n is None else np.add.reduceat(n, first, dtype=np.int64), MOST)
    key = key[first]
    out["code"] = key & 0xFFFF
    return out, np.cumsum(np.bincount(key >> 16, minlength=size))


def _count_contexts(shared):
    """Partial contexts of types and words; see above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, common = shared.value
        t, own, salt = types.count, len(types.own), TaskContext.get().partitionId() % SALT
        cells, waiting, size = np.zeros(t * t, np.int64), [], 0

        def rows(kind: int, h: np.ndarray, entries: np.ndarray, ends: np.ndarray, salted: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(np.where(salted, salt, 0).astype(np.int32)), _blobs(entries, ends)], schema=_SIDES)

        def words_held() -> Iterator[pa.RecordBatch]:
            h, code = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            order = np.argsort(h)
            h, code = h[order], code[order]
            del order
            new = np.r_[True, h[1:] != h[:-1]]
            h, group = h[new], np.cumsum(new)
            group -= 1
            entries, ends = _added(group, code, None, len(h))
            del group, code, new
            out = rows(1, h, entries, ends, _among(h, common)[0])
            for at in range(0, len(h), OUT_ROWS):
                yield out.slice(at, OUT_ROWS)

        for batch in batches:
            words = Words(batch.column(0))
            seq, place = in_sequence(words, types.of(words.hashes, endings(words)), types.end)
            if not len(seq):
                continue
            np.add.at(cells, np.r_[types.end, seq[:-1]] * t + seq, 1)
            more = np.flatnonzero(seq[place] >= own)
            before, behind = np.r_[types.end, seq[:-1]][place[more]], seq[place[more] + 1] + t
            waiting += [(words.hashes[more], x.astype(np.uint16)) for x in (before, behind)]
            size += 2 * len(more)
            if size > SIDES:
                yield from words_held()
                size = 0
        if size:
            yield from words_held()
        used = np.flatnonzero(cells)
        if len(used):
            h, inverse = np.unique(used // t, return_inverse=True)
            entries = np.empty(len(used), ENTRY)
            entries["code"], entries["n"] = used % t, np.minimum(cells[used], MOST)
            yield rows(0, h, entries, np.cumsum(np.bincount(inverse)), np.ones(len(h), bool))

    return count


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``kind, h, salt``, equal ones added; only the last key is held from one batch to the next."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch.cast(_SIDES)]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        keys = [c.to_numpy() for c in batch.columns[:3]]
        first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        entries, sizes = _entries(batch.column(3))
        group = np.repeat(np.searchsorted(first, np.arange(batch.num_rows), "right") - 1, sizes)
        entries, ends = _added(group, entries["code"], entries["n"], len(first))
        out = pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in keys), _blobs(entries, ends)], schema=_SIDES)
        held = out.slice(len(first) - 1)
        yield out.slice(0, len(first) - 1)
    if held is not None:
        yield held


_SIDES_DDL = "kind int, h long, salt int, sides binary"


def contexts(docs: DataFrame, types: Types, common: np.ndarray, work: Workspace) -> DataFrame:
    """``(kind, h, sides)`` of all types and words of ``docs(text)``; keys that many tasks hold are added by SALT first."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def added(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "kind", "h", "salt").sortWithinPartitions("kind", "h", "salt").mapInArrow(_merge, _SIDES_DDL)

    partial = docs.mapInArrow(_count_contexts(spark.sparkContext.broadcast((types, common))), _SIDES_DDL)
    once = work.put(added(partial), "contexts1")
    again = once.where("kind = 0").unionByName(once.where("kind = 1").join(F.broadcast(_keys(spark, common)), "h", "left_semi").select(*once.columns))
    twice = work.put(added(again.withColumn("salt", F.lit(0))), "contexts2")
    rest = once.where("kind = 1").join(F.broadcast(_keys(spark, common)), "h", "left_anti").select(*once.columns)
    return rest.unionByName(twice).drop("salt")


def _keys(spark: SparkSession, hashes: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"h": pa.array(hashes.view(np.int64), pa.int64())}))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(moves: np.ndarray) -> float:
    """What classes add to the log likelihood of the bigrams, up to a constant of the words."""
    return float(_xlogx(moves).sum() - _xlogx(moves.sum(axis=0)).sum() - _xlogx(moves.sum(axis=1)).sum())


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each type by the exchange algorithm; the last type (the end) keeps a class of its own, the last.

    Types move, the most frequent first, to the class that raises ``sum N(c, d) log N(c, d)
    - sum N(c) log N(c) - sum M(d) log M(d)`` most, for transition counts N and its row and column sums.
    """
    n = len(bigrams)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-weight[:-1], kind="stable")
    k = max(1, min(classes - 1, n - 1))
    member = np.full(n, k, np.int64)
    member[order] = np.arange(n - 1) % k
    b = bigrams.astype(np.float64)
    columns = np.ascontiguousarray(b.T)
    onehot = np.eye(k + 1)[member]
    moves = onehot.T @ b @ onehot
    reached = likelihood(moves)
    for _ in range(rounds):
        changed = 0
        for t in order.tolist():
            if not weight[t]:
                continue
            old = member[t]
            out = np.bincount(member, b[t], k + 1)
            into = np.bincount(member, columns[t], k + 1)
            own = b[t, t]
            out[old] -= own
            into[old] -= own
            # without t
            moves[old] -= out
            moves[:, old] -= into
            moves[old, old] -= own
            rows, cols = moves.sum(axis=1), moves.sum(axis=0)
            base = _xlogx(moves)
            # gain of putting t into class c: rows c and columns c change, and the cell (c, c)
            gain = (_xlogx(moves + out) - base).sum(axis=1) + (_xlogx(moves + into[:, None]) - base).sum(axis=0)
            d = np.diag(moves)
            gain += _xlogx(d + out + into + own) - _xlogx(d + out) - _xlogx(d + into) + np.diag(base)
            s_out, s_in = out.sum() + own, into.sum() + own
            gain -= _xlogx(rows + s_out) - _xlogx(rows) + _xlogx(cols + s_in) - _xlogx(cols)
            new = int(np.argmax(gain[:k]))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            changed += new != old
            member[t] = new
            moves[new] += out
            moves[:, new] += into
            moves[new, new] += own
        before, reached = reached, likelihood(moves)
        if not changed or reached - before < GAIN * abs(reached):
            break
    return member


class Model:
    """Classes of types and, once they are ``named``, of common words: all that finds the bigrams of a text but the rare words."""

    def __init__(self, types: Types, bigrams: np.ndarray, n_tokens: int, n_distinct: int, ends: int, common: tuple[np.ndarray, np.ndarray]):
        self.types, self.train_tokens, self.ends = types, n_tokens, ends
        self.cls = exchange(bigrams)
        self.classes = int(self.cls.max()) + 1
        self.h, self.c = common
        self.named = np.empty(0, np.int64)
        self.base = np.log10(n_tokens + 0.1 * (n_distinct + 1))

    @property
    def of_ending(self) -> np.ndarray:
        return self.cls[len(self.types.own) : self.types.end]


def estimates(moves: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of transitions, and of the emissions' denominators, which are to be subtracted."""
    k = len(moves)
    return np.log10((moves + MOVE) / (moves.sum(axis=1, keepdims=True) + MOVE * k)), np.log10(moves.sum(axis=0) + EMIT * (kinds + 1))


# exchange of the words without a type of their own; ``sides`` then hold classes: of the word before, then, moved by the number of
# classes, of an own type behind it, and, moved by it twice, of an ending behind it


def _by_class(shared):
    """Contexts by types to contexts by classes ``(h, c, sides)``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, own = shared.value
        t, k = len(cls), int(cls.max()) + 1
        behind = cls + np.where((np.arange(t) < own) | (np.arange(t) == t - 1), k, 2 * k)
        to = np.r_[cls, behind]
        for batch in batches:
            entries, sizes = _entries(batch.column(1))
            group, code, n = np.repeat(np.arange(len(sizes)), sizes), entries["code"], entries["n"].astype(np.int64)
            c = np.bincount(group, np.where(code < t, n, 0), len(sizes)).astype(np.int64)
            packed, ends = _added(group, to[code], n, len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c), _blobs(packed, ends)], ["h", "c", "sides"])

    return convert


def neighbour_gains(moves: np.ndarray) -> np.ndarray:
    """What a neighbour's code adds to the log likelihood of a word in each class but the last, which is the end's."""
    log = lambda x: np.log(np.maximum(x, 1e-2))
    k = len(moves)
    before = log(moves) - log(moves.sum(axis=0))
    behind = log(moves).T - log(moves.sum(axis=1))
    return np.concatenate([before, behind, behind])[:, : max(k - 1, 1)]


def _counts_of(column: pa.Array, k: int) -> np.ndarray:
    """Counts (word, code) as a dense matrix."""
    entries, sizes = _entries(column)
    cell = np.repeat(np.arange(len(sizes)), sizes) * (3 * k) + entries["code"]
    return np.bincount(cell, entries["n"], len(sizes) * 3 * k).reshape(len(sizes), 3 * k)


def _chosen(sides: pa.Array, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = _counts_of(sides, len(gains) // 3)
    return counts, (counts.astype(np.float32) @ gains.astype(np.float32)).argmax(axis=1)


def _round(shared):
    """Partial class bigrams ``(cell, n)`` of the words, each in the class that its neighbours make likeliest."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        k = len(gains) // 3
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                counts, y = _chosen(batch.column(0), gains)
                by = np.argsort(y, kind="stable")
                first = np.flatnonzero(np.r_[True, y[by][1:] != y[by][:-1]])
                sums = np.add.reduceat(counts[by], first, axis=0)
                classes = y[by][first]
                total[:, classes] += sums[:, :k].T
                total[classes] += sums[:, k : 2 * k]
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

    return step


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _chosen(batch.column(2), shared.value)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y.astype(np.int32))], ["h", "c", "cls"])

    return assign


def exchange_words(sides: DataFrame, inner: np.ndarray, moves: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """The neighbours' gains that class the words of ``sides(h, c, sides)``, and the likelihoods of the rounds.

    ``inner`` are the class bigrams between types of their own, ``moves`` those of all types, where the first round starts.
    """
    spark, k = sides.sparkSession, len(moves)
    gains, best, seen = neighbour_gains(moves), None, []
    for _ in range(rounds):
        total = inner.astype(np.float64).ravel().copy()
        found = sides.select("sides").mapInArrow(_round(spark.sparkContext.broadcast(gains)), "cell long, n double")
        for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            total[r.cell] += r.n
        seen.append(likelihood(total.reshape(k, k)))
        if best is not None and seen[-1] <= max(seen[:-1]):
            break
        best = gains
        if len(seen) > 1 and seen[-1] - seen[-2] < GAIN * abs(seen[-1]):
            break
        gains = neighbour_gains(total.reshape(k, k))
    return best, seen


# scores

_LONGS = pa.list_(pa.int64())
_SCANNED = (("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("class", pa.float64()), ("cells", pa.binary()), ("rare", _LONGS), ("k", _LONGS), ("default", pa.binary()), ("open", _LONGS))


def _listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, pa.int64()))


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (np.r_[0, ends] * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def scanned(model: Model, column: pa.Array) -> list[pa.Array]:
    """For each text: tokens; the known among the common ones and the end; base score and emissions of all but rare words' counts; cells of
    class bigrams without rare words; the rare words with how often they occur and the classes of their endings; bigrams with rare words."""
    words = Words(column)
    m, k, lens = len(column), model.classes, np.diff(words.bounds)
    owner = np.repeat(np.arange(m), lens)
    common, at = _among(words.hashes, model.h)
    counts = np.where(common, model.c[at] if len(model.h) else 0, 0)
    log = np.bincount(owner, np.where(common, np.log10(counts + 0.1), 0.0), m) + np.log10(model.ends + 0.1)
    known = np.bincount(owner, counts > 0, m).astype(np.int64) + int(model.ends > 0)
    # rare words of each text, numbered within it from 0
    rare = np.flatnonzero(~common)
    order = np.lexsort((words.hashes[rare], owner[rare]))
    h, o = words.hashes[rare][order], owner[rare][order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(h)])
    per_text = np.bincount(o[first], minlength=m) if len(h) else np.zeros(m, np.int64)
    ends = np.cumsum(per_text)
    number = np.arange(len(first)) - np.repeat(ends - per_text, per_text)
    code = np.where(common, model.named[at] if len(model.h) else 0, 0).astype(np.int64)
    code[rare[order]] = k + np.repeat(number, times)
    default = model.of_ending[endings(words)[rare[order][first]]].astype(np.uint8)
    last = int(model.cls[model.types.end])
    seq, _ = in_sequence(words, code, last)
    left, text = np.r_[last, seq[:-1]], np.repeat(np.arange(m), lens + 1)
    fixed = (left < k) & (seq < k)
    cells = (left * k + seq)[fixed].astype(np.uint16)
    open_ = ((left << 32) | seq)[~fixed]
    ends_of = lambda mask: np.cumsum(np.bincount(text[mask], minlength=m))
    n = lens + 1
    return [
        pa.array(n), pa.array(known), pa.array(log - n * model.base), pa.array(log), _cut(cells, ends_of(fixed)),
        _listed(h[first].view(np.int64), ends), _listed(times, ends), _cut(default, ends), _listed(open_, ends_of(~fixed)),
    ]


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *scanned(shared.value, batch.column(2))], ["doc_id", "held_out", *(n for n, _ in _SCANNED)])

    return scan


def _resolve(k: int):
    """Cells of the bigrams with rare words, from ``(row, held_out, log, more, open, default, found)`` with the classes found for rare words by number."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for pairs, default, found in zip(batch.column(4), batch.column(5).to_pylist(), batch.column(6), strict=True):
                code = np.r_[np.arange(k), np.frombuffer(default, np.uint8)].astype(np.int64)
                if found.is_valid:
                    number, cls = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
                    code[k + number] = cls
                x = pairs.values.to_numpy(zero_copy_only=False)
                cells.append((code[x >> 32] * k + code[x & 0xFFFFFFFF]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cells, pa.binary())], ["row", "held_out", "log", "more", "cells"])

    return resolve


def _cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All cells of binary values, and how many each has."""
    raw = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint16), np.array([len(x) // 2 for x in raw], np.int64)


def _total(size: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            out += np.bincount(_cells_of(batch.column(0))[0], minlength=size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["cell", "c"])

    return total


def _price(spark: SparkSession, costs: np.ndarray):
    """A column function: the sum of ``costs`` over the cells of a text."""
    shared = spark.sparkContext.broadcast(costs)

    @F.arrow_udf("double")
    def price(column: pa.Array) -> pa.Array:
        cells, sizes = _cells_of(column)
        return pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), shared.value[cells], len(sizes)))

    return price


def learn(texts: DataFrame, work: Workspace) -> tuple[Model, DataFrame, np.ndarray]:
    """From ``texts(text)``: the model, the class and count ``(h, c, cls)`` of every word without a type of its own, and the number of words of each class."""
    spark = texts.sparkSession
    words = work.put(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    ends = texts.count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    got = words.where(F.col("c") >= _threshold(words, "c", COMMON)).toPandas()
    h, c = got.h.to_numpy(np.int64).view(np.uint64), got.c.to_numpy(np.int64)
    by = np.argsort(h)
    h, c = h[by], c[by]
    types = Types(h[np.lexsort((h, -c))[:OWN]])
    found = contexts(texts, types, h, work)
    bigrams = np.zeros((types.count, types.count))
    for r in found.where("kind = 0").toLocalIterator():
        entries = np.frombuffer(bytes(r.sides), ENTRY)
        bigrams[r.h, entries["code"]] = entries["n"]
    model = Model(types, bigrams, int(total[0]) + ends, int(total[1]) + int(ends > 0), ends, (h, c))
    k, own = model.classes, len(types.own)
    sides = work.put(found.where("kind = 1").select("h", "sides").mapInArrow(_by_class(spark.sparkContext.broadcast((model.cls, own))), "h long, c long, sides binary"), "sides")
    work.drop("contexts1", "contexts2")
    onehot = np.eye(k)[model.cls]
    itself = np.r_[np.ones(own), np.zeros(ENDINGS), 1.0][:, None]
    gains, model.likelihoods = exchange_words(sides, (onehot * itself).T @ bigrams @ (onehot * itself), onehot.T @ bigrams @ onehot)
    classed = work.put(sides.mapInArrow(_assign(spark.sparkContext.broadcast(gains)), "h long, c long, cls int"), "classed")
    work.drop("sides", "words")
    model.named = np.full(len(h), -1, np.int64)
    is_own, at = _among(h, types.own)
    model.named[is_own] = model.cls[at[is_own]]
    rest = classed.join(F.broadcast(_keys(spark, h)), "h", "left_semi").toPandas()
    model.named[np.searchsorted(h, rest.h.to_numpy(np.int64).view(np.uint64))] = rest.cls.to_numpy(np.int64)
    kinds = np.bincount(model.cls[:own], minlength=k).astype(np.float64)
    for r in classed.groupBy("cls").agg(F.count("*").alias("n")).collect():
        kinds[r.cls] += r.n
    kinds[model.cls[types.end]] += int(ends > 0)
    return model, classed, kinds


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document; perplexity is ``10 ** (-score / n_tokens)``."""
    return scored(docs, Workspace(docs.sparkSession, "lm", keep=("scan", "sums")), folds, held)[0]


def scored(docs: DataFrame, work: Workspace, folds: int = 10, held: int = 0) -> tuple[DataFrame, Model]:
    spark = docs.sparkSession
    small_batches(spark)
    out_fold = (fold("doc_id", folds) == held).alias("held_out")
    with work:
        model, classed, kinds = learn(docs.where(~out_fold).select("text"), work)
        k = model.classes
        types = {pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", _LONGS: "array<long>"}
        ddl = ", ".join([docs.select("doc_id").schema.simpleString()[7:-1], "held_out boolean", *(f"{n} {types[t]}" for n, t in _SCANNED)])
        scan = docs.select("doc_id", out_fold, "text").mapInArrow(_scan(spark.sparkContext.broadcast(model)), ddl)
        scan = work.put(scan.withColumn("row", F.monotonically_increasing_id()), "scan")
        rare = scan.select("row", F.posexplode(F.arrays_zip("rare", "k")).alias("i", "e")).select("row", "i", F.col("e.rare").alias("h"), "e.k")
        counted = rare.join(classed.select("h", "c", "cls"), "h")
        log = F.col("k") * F.log10(F.col("c") + 0.1) - F.col("k") * F.lit(float(np.log10(0.1)))
        found = counted.groupBy("row").agg(F.sum(log).alias("log"), F.sum("k").alias("more"), F.collect_list(F.struct("i", "cls")).alias("found"))
        found = scan.where("size(open) > 0").select("row", "held_out", "k", "open", "default").join(found, "row", "left")
        # words that no training text holds count 0.1 each, all others what was found beyond that
        unseen = F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + x) * F.lit(float(np.log10(0.1)))
        found = found.select("row", "held_out", (F.coalesce("log", F.lit(0.0)) + unseen).alias("log"), F.coalesce("more", F.lit(0)).alias("more"), "open", "default", "found")
        sums = work.put(found.mapInArrow(_resolve(k), "row long, held_out boolean, log double, more long, cells binary"), "sums")
        cells = scan.unionByName(sums, allowMissingColumns=True).where("not held_out").select("cells").mapInArrow(_total(k * k), "cell long, c long")
        moves = np.zeros(k * k)
        for r in cells.groupBy("cell").agg(F.sum("c").alias("c")).collect():
            moves[r.cell] = r.c
        move, emit = estimates(moves.reshape(k, k), kinds)
        price = _price(spark, (move - emit).ravel())
        sums = sums.select("row", "log", "more", price("cells").alias("part"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scan.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "class", price("cells").alias("priced")).join(sums, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("more")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("log")).alias("base_score"),
        (F.col("class") + F.col("priced") + zero("log") + zero("part")).alias("score"),
    ), model


def _threshold(words: DataFrame, column: str, most: int) -> int:
    """The least count that at most ``most`` words reach, from a histogram of counts."""
    step = F.floor(F.log2(column) * 8)
    kept, least = 0, None
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("low")).orderBy(F.desc("s")).collect():
        kept += r.n
        if kept > most:
            break
        least = r.low
    return int(least) if least is not None else 1 << 62


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_brown_lm": op9_brown_lm}
