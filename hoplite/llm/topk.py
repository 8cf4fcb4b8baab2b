"""Exact top-k by inner product over a bit-sliced index.

Vectors become integers, ``floor(1024 x)`` per component. A block of candidates keeps, for each
component, one bitmap per bit ("slice"). A query's score for all rows of the block is a sum of
component slices shifted by the bits of the query's components: bitmap additions with carries
that give the slices of the scores, about eight rows to a byte and no row-wise work. Components are
taken by their leading slices only, which bounds the error of the sum; the
rows that the most significant slices leave in question around the k-th are resolved by
exact integer products.

The index is written once: a row per block with its ids, its integer vectors and their slices. Queries are sent to the executors in groups
of bounded size, each group reads the index, and each task returns at most k rows per query, so what is
shuffled depends on the number of tasks; the results of a group are written before the next one is sent.

Vectors with a component of ``WIDE`` or more after scaling, as queries or as candidates, leave 64-bit arithmetic: they are kept as
they came, in small blocks of their own, and their products are taken as whole numbers of any length.

Defined results: vectors that are null or hold a null or non-finite component, and candidates whose dimension differs from
the query's, take no part; a row with the query's vec_id is the query itself; a query id that repeats is asked
once (its first vector by content); a null vec_id is never a query and ranks after all ids in ties. Scores are ranked exactly; one
beyond 64 bits is shown as the nearest 64-bit number. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hoplite.llm.common import small_batches, table
from hoplite.plans.workspace import Workspace

SCALE, K, EVERY = 1024, 10, 100
#: Rows and components of a block: what a task holds at a time. Wide blocks have fewer rows.
BLOCK_ROWS, BLOCK_CELLS, WIDE_ROWS = 1 << 15, 1 << 21, 256
#: Components of queries (count x dimension) sent at once.
GROUP_CELLS = 2_000_000
#: Trailing slices of the candidates' components that the sums leave out.
DROPPED = 3
#: Scaled components from which on products are not left to 64-bit numbers: 2**48 a product, for up to 32,768 components.
WIDE = 1 << 24
LONG = (1 << 63) - 1


def taking_part(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)`` with components as doubles, of the vectors that take part."""
    x = F.col("embedding")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("x"))


def is_wide(x: np.ndarray) -> bool:
    return bool(np.abs(x).max() * SCALE >= WIDE - 1)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """``floor(1024 x)`` as Python's whole numbers, exact for every finite component."""
    big = lambda c: int(c) * SCALE if abs(c) >= 1 << 53 else int(np.floor(c * SCALE))
    return np.array([big(c) for c in x.ravel().tolist()], object).reshape(x.shape)


class Slices:
    """Bit slices of a block of integer vectors: ``planes[component, bit]`` is a bitmap of rows."""

    def __init__(self, rows: np.ndarray, planes: np.ndarray, dropped: int):
        self.rows, self.planes, self.dropped, self.n = rows, planes, dropped, len(rows)
        self.valid = _words(np.packbits(np.ones(self.n, bool), bitorder="little"))

    @classmethod
    def of(cls, rows: np.ndarray, dropped: int = DROPPED) -> "Slices":
        above = (rows - rows.min(axis=0)).astype(np.uint64)
        bits = max(1, int(above.max()).bit_length())
        dropped = min(dropped, bits - 1)
        planes = np.empty((rows.shape[1], bits - dropped, -(-len(rows) // 64)), np.uint64)
        for b in range(dropped, bits):
            packed = np.packbits((above >> np.uint64(b)) & np.uint64(1) != 0, axis=0, bitorder="little")
            for d in range(rows.shape[1]):
                planes[d, b - dropped] = _words(packed[:, d])
        return cls(rows, planes, dropped)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum, over the signed binary digits of the query's components, of the kept slices so shifted, and the digits' sum.

        A negative digit adds the complement of the slices; that shifts the sums of all rows alike.
        """
        columns: dict[int, list[np.ndarray]] = {}
        total = 0
        for d in np.flatnonzero(query).tolist():
            q, shift = int(query[d]), 0
            while q:
                if q & 1:
                    digit = 2 - (q & 3)  # 1 or -1, so that the next digit is 0
                    q -= digit
                    total += 1 << shift
                    for b in range(self.planes.shape[1]):
                        columns.setdefault(b + shift, []).append(self.planes[d, b] if digit > 0 else self.planes[d, b] ^ self.valid)
                q >>= 1
                shift += 1
        out, at = [], 0
        while columns:
            # carry-save: three bitmaps of one weight become a sum and a carry of the next
            stack = columns.pop(at, [])
            while len(stack) > 2:
                a, b, c = stack.pop(), stack.pop(), stack.pop()
                x = a ^ b
                stack.insert(0, x ^ c)
                columns.setdefault(at + 1, []).append((a & b) | (x & c))
            if len(stack) == 2:
                a, b = stack
                stack = [a ^ b]
                columns.setdefault(at + 1, []).append(a & b)
            out.append(stack[0] if stack else np.zeros_like(self.valid))
            at += 1
        return out, total

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k with the highest product with ``query``: a superset of them with all ties."""
        slices, digits = self.sums(query)
        if self.n <= k or not slices:
            return np.arange(self.n)
        # from the most significant slice downward: the value of the k-th row
        sure, tied, value = 0, self.valid, 0
        for i in range(len(slices) - 1, -1, -1):
            both = tied & slices[i]
            n = int(np.bitwise_count(both).sum())
            if sure + n >= k:
                tied, value = both, value | 1 << i
            else:
                sure, tied = sure + n, tied & ~slices[i]
        # what was left out is between 0 and (2**dropped - 1) times the digit for each digit
        slack = digits * ((1 << self.dropped) - 1) >> self.dropped
        least = max(0, value - slack - 1)
        above, equal = np.zeros_like(self.valid), self.valid
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        keep = np.unpackbits((above | equal).view(np.uint8), count=self.n, bitorder="little")
        return np.flatnonzero(keep)


def _words(packed: np.ndarray) -> np.ndarray:
    """Bytes padded to 64-bit words."""
    out = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)


NO_ID = np.iinfo(np.int64).max
_INDEX = pa.schema([("dim", pa.int32()), ("dropped", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("planes", pa.binary())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``(vec_id, x)``: 32-bit integers with slices, or (``dropped`` is -1) the components of wide vectors as they came."""
    held: dict[tuple[int, bool], tuple[list[int], list[np.ndarray]]] = {}

    def block(dim: int, wide: bool) -> pa.RecordBatch:
        ids, rows = held.pop((dim, wide))
        x = np.stack(rows)
        if wide:
            dropped, stored, planes = -1, x, b""
        else:
            stored = np.floor(x * SCALE).astype(np.int32)
            slices = Slices.of(stored.astype(np.int64))
            dropped, planes = slices.dropped, slices.planes.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((dim, dropped, np.array(ids, np.int64).tobytes(), stored.tobytes(), planes), _INDEX, strict=True)], schema=_INDEX)

    for batch in batches:
        values = batch.column(1)
        flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(values.value_lengths().to_numpy())
        for i, x in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]) if len(ends) else [], strict=True):
            kind = len(x), is_wide(x)
            ids, rows = held.setdefault(kind, ([], []))
            ids.append(NO_ID if i is None else i)
            rows.append(x)
            if len(rows) >= (WIDE_ROWS if kind[1] else min(BLOCK_ROWS, max(64, BLOCK_CELLS // kind[0]))):
                yield block(*kind)
    for kind in list(held):
        yield block(*kind)


class Block:
    """A block of the index as read back."""

    def __init__(self, dim: int, dropped: int, ids: bytes, rows: bytes, planes: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        if dropped < 0:
            self.slices, self.exact = None, whole_numbers(np.frombuffer(rows, np.float64).reshape(-1, dim))
        else:
            n = len(self.ids)
            whole = np.frombuffer(rows, np.int32).reshape(n, dim).astype(np.int64)
            self.slices = Slices(whole, np.frombuffer(planes, np.uint64).reshape(dim, -1, -(-n // 64)), dropped)
            self.exact = whole

    def best(self, qid: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best other rows; one row more is fetched for each that is the query itself."""
        own = int(np.count_nonzero(self.ids == qid))
        if self.slices is None or query.dtype == object:
            rows = np.flatnonzero(self.ids != qid)
            scores = np.concatenate([self.exact[part].astype(object) @ query.astype(object) for part in np.array_split(rows, -(-len(rows) // 1024))]) if len(rows) else np.empty(0, object)
        else:
            rows = self.slices.candidates(query, k + own)
            rows = rows[self.ids[rows] != qid]
            scores = self.exact[rows] @ query
        found = sorted(zip((-scores).tolist(), self.ids[rows].tolist(), strict=True))[:k]
        return [(-s, i) for s, i in found]


def order_key(score: int) -> bytes:
    """Bytes that sort as scores of any length do."""
    size = (abs(score).bit_length() + 8) // 8
    body = score.to_bytes(size, "big", signed=True)
    return (0x8000 + size if score >= 0 else 0x8000 - size).to_bytes(2, "big") + body


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])


def _searcher(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value  # dimension -> [(id, vector)]
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if row[0] not in queries:
                    continue
                block = Block(*row)
                for qid, query in queries[row[0]]:
                    got = best.get(qid, []) + block.best(qid, query, k)
                    best[qid] = sorted(got, key=lambda x: (-x[0], x[1]))[:k]
        found = [(q, i, max(-LONG - 1, min(LONG, s)), order_key(s)) for q, hits in best.items() for s, i in hits]
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return search


def _asked(rows) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Queries by dimension, as integers, or as Python's whole numbers where they are wide."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in rows:
        x = np.array(r.x, np.float64)
        out.setdefault(len(x), []).append((r.vec_id, whole_numbers(x) if is_wide(x) else np.floor(x * SCALE).astype(np.int64)))
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best rows of each query, the rows whose vec_id ``every`` divides: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    small_batches(spark)
    with Workspace(spark, "topk", keep=("best",)) as work:
        rows = taking_part(vectors)
        index = work.put(rows.mapInArrow(_index, "dim int, dropped int, ids binary, rows binary, planes binary"), "index")
        asked = work.put(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")), "asked")
        cells = asked.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
        groups = max(1, -(-cells // GROUP_CELLS))
        best = None
        for g in range(groups):  # a group of queries against all rows
            mine = _asked(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toLocalIterator())
            found = index.mapInArrow(_searcher(spark.sparkContext.broadcast(mine), k), "query_id long, vec_id long, score long, key binary")
            best = work.add(found, "best")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_exact_topk": op10_exact_topk}

ORACLES = {
    "op10_exact_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
