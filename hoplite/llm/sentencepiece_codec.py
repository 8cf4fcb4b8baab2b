"""SentencePiece encoding and decoding by a max-plus scan.

The model is a merge-order one: the piece of the best score that two neighbouring symbols make is merged first, the
leftmost of equal ones. A segmentation is the model's own exactly if every piece is what the merges make
of its text alone and every two adjacent pieces are what they make of their joint text, because a merge
across a border would show in those two pieces alone. So a path of pieces over the positions of a text
weighs 0 if all its neighbours are compatible and minus infinity if not, and the heaviest path, a product of max-plus
matrices, is the segmentation. For every beginning of a text there is one segmentation, so the
scan keeps one last piece for each position, and no tie is possible.

A position is a *cut* if no piece of the vocabulary can span it (in front of a blank that follows another
character, around characters of no longer piece): stretches between cuts ("units") are solved apart, equal units once.

Texts above ``GIANT`` characters are split into chunks of ``CHUNK``, which different tasks take:

1. the state at a border is the piece, with its place, that holds the character before it; each chunk yields the transfer
   matrix from the states at its left border to those at its right one;
2. the matrices of a text are combined associatively, ``FAN`` at a time in a tree, which leaves one state at every border;
3. each chunk is backtraced alone between its two states.

The ids are those of the model whatever the sizes of chunks: ``GIANT`` and ``CHUNK`` choose where the work is done, not the result.
Normalisation is the identity, a blank becomes U+2581, one is put in front; a character in no piece is written as its
byte pieces. Decoding gives back every text exactly, but that U+2581 itself becomes a blank, as the format has it.
Models with unused or user-defined pieces are refused.

Defined results: a null text has null pieces, an empty one none; each row of ``docs`` gives one row; all other columns are kept
by the pipeline stage (a column ``piece_ids`` is replaced) and ignored by the query.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import batches_of, small_batches, table
from hoplite.plans.workspace import Workspace

#: Characters above which a text is split, and of a chunk.
GIANT, CHUNK = 1 << 16, 1 << 15
#: Matrices that one group combines.
FAN = 64
#: Units whose segmentation, and pairs of pieces whose compatibility, a worker remembers.
CACHE, PAIRS = 400_000, 400_000
BLANK = "▁"
NEVER = -np.inf


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Pieces and scores of a model file; see the module for the rules.

    Pieces are numbered by their ids; then come ``free``, a symbol that is compatible with everything (the
    beginning of a text, a character in no piece), and the characters that occur in pieces without being one.
    """

    def __init__(self, pieces: dict[str, tuple[float, int]], byte_ids: list[int], by_id: list[str]):
        self.pieces, self.byte_ids, self.by_id = pieces, byte_ids, by_id
        self.score = {p: s for p, (s, _) in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.free = len(by_id)
        inner = {c for p in pieces if len(p) > 1 for c in p}
        #: number -> states that the ends of a piece pass through while it is merged: (score, first symbol, last symbol)
        self.stages: dict[int, list[tuple[float, str, str]]] = {}
        self.numbers: dict[str, int] = {}
        self.places = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        single = sorted(c for c in inner if c not in pieces)
        for piece, number in [*((p, i) for p, (_, i) in pieces.items()), *((c, self.free + 1 + k) for k, c in enumerate(single))]:
            whole, stages = self._merged(piece)
            if whole:  # any other never comes out of the merges
                self.stages[number] = stages
                self.numbers[piece] = number
                self.places.add_word(piece, len(piece) << 20 | number)
        self.places.make_automaton()
        self.unit = re.compile(self._units(inner), re.S)
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.spelt = [p.replace(BLANK, " ").encode("utf-8", "surrogatepass") for p in by_id]
        for b, i in enumerate(byte_ids):
            if i:
                self.spelt[i] = bytes([b])

    def __getstate__(self):
        return self.pieces, self.byte_ids, self.by_id

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str) -> "Codec":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, by_bytes = {}, [0] * 256
        names = [p.id_to_piece(i) for i in range(p.vocab_size())]
        for i, name in enumerate(names):
            if p.is_byte(i):
                by_bytes[int(name[3:5], 16)] = i
            elif p.is_unused(i):
                raise ValueError(f"unused piece {name!r}")
            elif not (p.is_control(i) or p.is_unknown(i)):
                pieces[name] = (float(p.get_score(i)), i)
        return cls(pieces, by_bytes, names)

    def _units(self, inner: set[str]) -> str:
        """A pattern whose matches begin and end at cuts: blanks with what follows, letters, other characters, each
        as long as the vocabulary has pieces across what lies between."""
        if not inner:
            return "."
        kind = lambda c: 0 if c == BLANK else 1 if c.isalpha() else 2
        met = {(kind(x), kind(y)) for p in self.pieces for x, y in zip(p, p[1:])}
        letters, others = ("".join(map(re.escape, sorted(c for c in inner if kind(c) == k))) for k in (1, 2))
        if (1, 0) in met or (2, 0) in met:
            return f"[{BLANK}{letters}{others}]+|."
        runs = [f"[{r}]+" for r in ([letters + others] if (1, 2) in met or (2, 1) in met else [letters, others]) if r]
        return "|".join([f"{BLANK}+(?:{'|'.join(runs)})?", *runs, "."])

    # which pieces can be neighbours

    def _merged(self, text: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether the merges make one symbol of ``text``, and the stages of its ends."""
        symbols = list(text)
        stages = [(np.inf, symbols[0], symbols[-1])]
        while len(symbols) > 1:
            found = [(-s, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (s := self.score.get(a + b)) is not None]
            if not found:
                break
            cost, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            stages.append((-cost, symbols[0], symbols[-1]))
        return len(symbols) == 1, stages

    def meets(self, a: int, b: int) -> bool:
        """Whether the merges of the joint text of ``a`` and ``b`` leave the border between them."""
        if a == self.free or b == self.free:
            return True
        left, right, score = self.stages[a], self.stages[b], self.score
        i = j = 0
        while True:
            next_a = left[i + 1][0] if i + 1 < len(left) else NEVER
            next_b = right[j + 1][0] if j + 1 < len(right) else NEVER
            across = score.get(left[i][2] + right[j][1])
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    # the max-plus recursion

    def forward(self, text: str, start: int, number: int, stop: int) -> tuple[list[int], list[int]]:
        """For all places of ``text`` the last piece of a path of weight 0 that is at ``start`` after the piece ``number`` and whose
        pieces begin before ``stop``, -1 where there is none; and where that piece begins."""
        n, free, pairs, meets = len(text), self.free, self.pairs, self.meets
        last, begins = [-1] * (n + 1), [-1] * (n + 1)
        last[start] = number
        done = start
        for end, value in self.places.iter(text, start):
            end += 1
            while done < end - 1:  # a character in no piece
                done += 1
                if last[done - 1] >= 0 and done - 1 < stop:
                    last[done], begins[done] = free, done - 1
            done = end
            if last[end] >= 0:
                continue
            begin = end - (value >> 20)
            if begin < start or begin >= stop or (before := last[begin]) < 0:
                continue
            this = value & 0xFFFFF
            if before != free:
                key = before << 20 | this
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = meets(before, this)
                if not ok:
                    continue
            last[end], begins[end] = this, begin
        while done < n:
            done += 1
            if last[done - 1] >= 0 and done - 1 < stop:
                last[done], begins[done] = free, done - 1
        return last, begins

    def trace(self, text: str, path: tuple[list[int], list[int]], start: int, end: int) -> list[int]:
        last, begins = path
        out: list[int] = []
        while end > start:
            this, begin = last[end], begins[end]
            if this < self.free:
                out.append(this)
            else:
                out += [self.byte_ids[b] for b in reversed(text[begin:end].encode("utf-8", "surrogatepass"))]
            end = begin
        return out[::-1]

    def solved(self, unit: str) -> bytes:
        """Ids of a unit as int32 bytes; the first CACHE units that a worker meets are remembered.

        The scan goes on from the place that the longest piece reaches and comes back to shorter ones. All paths to a place
        end in the same piece, so a place from which the end can't be reached is passed by from then on.
        """
        numbers, pairs, reach, free, n = self.numbers, self.pairs, self.places.longest_prefix, self.free, len(unit)
        at, before, path, dead = 0, free, [], set()
        size = reach(unit)
        while at < n:
            while size:
                this = numbers.get(unit[at : at + size])
                if this is not None and (not dead or at + size not in dead):
                    if before == free or this == free:
                        break
                    key = before << 20 | this
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.meets(before, this)
                    if ok:
                        break
                size -= 1
            else:
                if at == 0:  # a character in no piece is a unit alone
                    self.cache[unit] = self._bytes(unit)
                    return self.cache[unit]
                dead.add(at)
                before, _, size = path.pop()
                at -= size
                size -= 1
                continue
            path.append((before, this, size))
            at += size
            before = this
            size = reach(unit[at : at + self.longest])
        if before < free and all(i < free for _, i, _ in path):
            found = array("i", [i for _, i, _ in path]).tobytes()
        else:
            found, at = b"", 0
            for _, i, size in path:
                found += array("i", [i]).tobytes() if i < free else self._bytes(unit[at : at + size])
                at += size
        if n <= 64 and len(self.cache) < CACHE:
            self.cache[unit] = found
        return found

    def _bytes(self, text: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]).tobytes()

    @staticmethod
    def prepared(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def encode_prepared(self, text: str) -> bytes:
        get, solved = self.cache.get, self.solved
        return b"".join([get(unit) or solved(unit) for unit in self.unit.findall(text)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_prepared(self.prepared(text)), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    # chunks: ``text`` holds up to ``longest`` characters before the left border and after the right one

    def states(self, text: str, border: int) -> list[tuple[int, int, int]]:
        """(begin, end, number) of all pieces that hold the character before ``border``, in a fixed order; places are relative to it."""
        if border == 0:
            return [(0, 0, self.free)]
        low = max(0, border - self.longest)
        found = []
        for end, value in self.places.iter(text[low : border + self.longest - 1]):
            end += low + 1
            begin = end - (value >> 20)
            if begin < border <= end:
                found.append((begin - border, end - border, value & 0xFFFFF))
        return sorted(found) or [(-1, 0, self.free)]

    def _first_cut(self, text: str, low: int, high: int) -> int | None:
        """The first cut at ``low`` or behind, before ``high``."""
        for m in self.unit.finditer(text, low - 1, high):
            if low <= m.end() < high and self.unit.fullmatch(text, m.end() - 1, m.end() + 1) is None:
                return m.end()
        return None

    def _paths(self, text: str, left: int, right: int) -> list[tuple[list[int], list[int]]]:
        """The forward scan from each state at the left border; behind the first cut they share one."""
        states = self.states(text, left)
        cut = self._first_cut(text, left + self.longest, right)
        if cut is None:
            return [self.forward(text, left + e, n, right) for _, e, n in states]
        rest = self.forward(text, cut, self.free, right)
        out = []
        for _, e, n in states:
            last, begins = self.forward(text[:cut], left + e, n, cut)
            if last[cut] >= 0:
                out.append((last[:cut] + [last[cut]] + rest[0][cut + 1 :], begins[: cut + 1] + rest[1][cut + 1 :]))
            else:
                none = [-1] * (len(text) + 1)
                out.append((none, none))
        return out

    def matrix(self, text: str, left: int, right: int) -> np.ndarray:
        """Max-plus transfer matrix between the states at two borders."""
        ends = self.states(text, right)
        out = np.full((len(self.states(text, left)), len(ends)), NEVER, np.float32)
        for i, (last, begins) in enumerate(self._paths(text, left, right)):
            for j, (b, e, n) in enumerate(ends):
                if last[right + e] == n and begins[right + e] == right + b:
                    out[i, j] = 0.0
        # a piece over both borders is one state at each
        for i, (b, e, n) in enumerate(self.states(text, left)):
            for j, end in enumerate(ends):
                if left and e >= right - left and (b + left - right, e + left - right, n) == end:
                    out[i, j] = 0.0
        return out

    def chunk_ids(self, text: str, left: int, right: int, i: int, j: int) -> bytes:
        """Ids of the pieces after state ``i`` at the left border up to state ``j`` at the right one."""
        _, e, number = self.states(text, left)[i]
        end = right + self.states(text, right)[j][1]
        if left + e >= end:
            return b""
        path = self.forward(text[:end], left + e, number, right)
        return array("i", self.trace(text, path, left + e, end)).tobytes()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chosen_states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States at all borders (one more than there are chunks) of the path from state ``first`` to state ``last``."""
    ahead = [np.where(np.arange(len(matrices[0])) == first, 0.0, NEVER)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    behind = [np.where(np.arange(matrices[-1].shape[1]) == last, 0.0, NEVER)]
    for m in reversed(matrices):
        behind.append((m + behind[-1][None, :]).max(axis=1))
    return [int(np.argmax(a + b)) for a, b in zip(ahead, reversed(behind), strict=True)]


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def _encoded_lists(codec: Codec, column: list[str | None], giant: int) -> tuple[list[bytes | None], pa.Array]:
    """Ids of each text as int32 bytes, and as a list array; null for null and for texts above ``giant`` characters."""
    raw = [None if t is None or len(t) > giant else codec.encode_prepared(codec.prepared(t)) for t in column]
    ends = np.cumsum([0, *(len(r) // 4 if r is not None else 0 for r in raw)])
    values = pa.array(np.frombuffer(b"".join(r or b"" for r in raw), np.int32))
    return raw, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in raw]))


# columns that Catalyst must not compute again for each of their uses are marked as not deterministic, which they are


def encoder(codec: Codec, spark: SparkSession, giant: int = GIANT):
    """A column function: text to ids; null for null and for texts above ``giant`` characters."""
    shared = spark.sparkContext.broadcast(codec)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        return _encoded_lists(shared.value, column.to_pylist(), giant)[1]

    return encode.asNondeterministic()


def decoder(codec: Codec, spark: SparkSession):
    """A column function: ids to text."""
    shared = spark.sparkContext.broadcast(codec)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        c = shared.value
        return pa.array([None if x.as_py() is None else c.decode(x.values.to_numpy().tolist()) for x in column], pa.string())

    return decode


def both_ways(codec: Codec, spark: SparkSession, giant: int = GIANT):
    """A column function: text to ``struct(ids, same)``: the ids, and whether decoding them gives the text back; one Python worker does both."""
    shared = spark.sparkContext.broadcast(codec)

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def there_and_back(column: pa.Array) -> pa.Array:
        c, given = shared.value, column.to_pylist()
        raw, ids = _encoded_lists(c, given, giant)
        same = [r is None or c.decode(_ids(r).tolist()) == t.replace(BLANK, " ") for r, t in zip(raw, given, strict=True)]
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "same"])

    return there_and_back.asNondeterministic()


def _split(shared, chunk: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = shared.value.longest

        def rows():
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = Codec.prepared(text)
                    for part, at in enumerate(range(0, len(text), chunk)):
                        low, end = max(0, at - reach), min(at + chunk, len(text))
                        yield row, part, at - low, end - low, text[low : end + reach]

        yield from batches_of(rows(), CHUNKS, 64)

    return split


CHUNKS = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("text", pa.string())])
_MATRIX = "row long, part int, rows int, m binary"


def _matrices(shared):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, left, right, text = (c.to_pylist() for c in batch.columns)
            m = [shared.value.matrix(t, a, b) for t, a, b in zip(text, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in m], pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], ["row", "part", "rows", "m"])

    return made


def _read_matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32).reshape(rows, -1)


def _products(key, frame):
    """The product of the matrices of a group."""
    import pandas as pd

    frame = frame.sort_values("part")
    total = None
    for raw, rows in zip(frame["m"], frame["rows"], strict=True):
        m = _read_matrix(raw, rows)
        total = m if total is None else product(total, m)
    return pd.DataFrame({"row": [key[0]], "part": [key[1]], "rows": [len(total)], "m": [total.tobytes()]}).astype({"part": "int32", "rows": "int32"})


def _inside(key, frame):
    """States at the borders inside a group, from those at its ends (``i``, ``j``)."""
    import pandas as pd

    frame = frame.sort_values("part")
    at = chosen_states([_read_matrix(raw, rows) for raw, rows in zip(frame["m"], frame["rows"], strict=True)], int(frame["i"].iloc[0]), int(frame["j"].iloc[0]))
    return pd.DataFrame({"row": frame["row"], "part": frame["part"], "i": np.array(at[:-1], np.int32), "j": np.array(at[1:], np.int32)})


def border_states(matrices: DataFrame, work: Workspace, fan: int = FAN, level: int = 0) -> DataFrame:
    """``matrices(row, part, rows, m)`` to the state numbers ``(row, part, i, j)`` at both borders of each part: up a tree by products,
    down it by the states at a node's ends. The tree's depth is that of the longest text's parts."""
    group = F.floor(F.col("part") / fan).cast("int")
    most = matrices.agg(F.max("part")).first()[0]
    if most == 0:  # one matrix a text, from the only state at its beginning to the one that ends with the text

        @F.arrow_udf("int")
        def last(raw: pa.Array, rows: pa.Array) -> pa.Array:
            return pa.array([int(np.argmax(_read_matrix(m, n)[0])) for m, n in zip(raw.to_pylist(), rows.to_pylist(), strict=True)], pa.int32())

        return matrices.select("row", "part", F.lit(0).alias("i"), last("m", "rows").alias("j"))
    above = work.put(matrices.withColumn("part0", group).groupBy("row", "part0").applyInPandas(_products, _MATRIX), f"level{level}")
    ends = border_states(above, work, fan, level + 1).withColumnRenamed("part", "part0")
    held = matrices.withColumn("part0", group).join(ends, ["row", "part0"])
    return work.put(held.groupBy("row", "part0").applyInPandas(_inside, "row long, part int, i int, j int"), f"states{level}")


def encode_giants(giants: DataFrame, codec: Codec, work: Workspace, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``giants(row, text)`` to ``(row, ids)`` by chunks that any number of tasks share."""
    spark = work.spark
    shared = spark.sparkContext.broadcast(codec)
    parts = work.put(giants.where("text <> ''").mapInArrow(_split(shared, chunk), "row long, part int, left int, right int, text string").repartition("row", "part"), "chunks")
    matrices = work.put(parts.mapInArrow(_matrices(shared), _MATRIX), "matrices")

    @F.arrow_udf("array<int>")
    def traced(text: pa.Array, left: pa.Array, right: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
        c = shared.value
        return pa.array([_ids(c.chunk_ids(*x)) for x in zip(*(a.to_pylist() for a in (text, left, right, i, j)), strict=True)], pa.list_(pa.int32()))

    states = border_states(matrices, work, fan)
    ids = parts.join(states, ["row", "part"]).select("row", F.struct("part", traced("text", "left", "right", "i", "j").alias("ids")).alias("p"))
    return work.put(ids.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids")), "giants")


def encoded(docs: DataFrame, model_path: str | None = None, giant: int = GIANT, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """``docs`` with the column ``piece_ids``; with ``check`` also ``round_trip``, whether decoding them gives the text back (true for null)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("piece_ids", *["round_trip"] * check)
    codec = Codec.load(model_path or default_model_path())
    is_giant = F.length("text") > giant
    short = docs.where(F.coalesce(~is_giant, F.lit(True)))
    if check:
        short = short.withColumn("piece_ids", both_ways(codec, spark, giant)("text"))
        short = short.select(*docs.columns, F.col("piece_ids.ids").alias("piece_ids"), F.col("piece_ids.same").alias("round_trip"))
    else:
        short = short.withColumn("piece_ids", encoder(codec, spark, giant)("text"))
    large = docs.where(is_giant)
    if large.isEmpty():
        return short
    work = Workspace(spark, "pieces", keep=("rows", "giants"))
    with work:
        rows = work.put(large.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
        ids = encode_giants(rows.select("row", F.col("doc.text").alias("text")), codec, work, chunk)
    done = rows.join(ids, "row").select("doc.*", F.col("ids").alias("piece_ids"))
    if check:
        done = done.withColumn("round_trip", decoder(codec, spark)("piece_ids").eqNullSafe(F.translate("text", BLANK, " ")))
    return short.unionByName(done)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, a digest of their ids, and whether decoding them gives the text back."""
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return docs.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256).alias("pieces_sha256"), "round_trip")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
