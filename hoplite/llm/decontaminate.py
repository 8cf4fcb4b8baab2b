"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hash of ``GRAM`` consecutive words in every run
of ``RUN`` such hashes. ``GRAM + RUN - 1`` equals the window of 10 words, so every
shared window shares a fingerprint at the same place of it. A document's
fingerprints are looked up among those of the benchmark; each hit is
extended to the windows around it, which are compared word by word. Items
with fewer words than a window are one window themselves and
are found by runs of just their length.

The benchmark's windows are sent to the executors in blocks of bounded size, as sorted arrays of hashes with the places of
their words in one buffer: about five bytes for each byte of ``BLOCK_BYTES`` of text. One block is held
against all documents. Several are held against the documents that share a fingerprint with them: fingerprints of
both sides meet in a join, so each further block reads only its own documents, and the hits of the blocks
are united per document.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no window;
``n_items`` counts distinct ids, an item without id marks words but is not counted; every row of
``docs`` gives one row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from hoplite.llm.common import ALPHANUMERIC, Words, mixed, small_batches, table, window_hashes, windows_at, word_hashes
from hoplite.plans.workspace import Workspace

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
#: Bytes of benchmark text whose windows one block holds.
BLOCK_BYTES = 16 << 20

#: The hash of no gram.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Lower-cases A-Z and turns every other ASCII character but digits and letters into a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other non-ASCII characters; A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


def fingerprint_places(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the hashes that are smallest in some run of ``run``; all of equal ones."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.arange(0)
    lows = np.lib.stride_tricks.sliding_window_view(grams, run).min(axis=1)
    chosen = np.zeros(len(grams), bool)
    for i in range(run):
        chosen[i : i + n] |= grams[i : i + n] == lows
    return np.flatnonzero(chosen)


class Windows:
    """Windows of one length: hashes in ascending order, and for each where its words begin and end in the text buffer, and its item."""

    def __init__(self, hashes: list[np.ndarray], starts: list[np.ndarray], ends: list[np.ndarray], owners: list[np.ndarray]):
        h = np.concatenate(hashes)
        by = np.argsort(h, kind="stable")
        self.hashes = h[by]
        self.starts, self.ends = np.concatenate(starts)[by], np.concatenate(ends)[by]
        self.owners = np.concatenate(owners)[by]


class Block:
    """Windows of some items: fingerprints, and the windows of each length."""

    def __init__(self, items: Iterator[tuple[str | None, str]]):
        self.names: list[str | None] = []
        parts: dict[int, tuple[list, list, list, list]] = {}
        prints, buffer, size_so_far = [np.empty(0, np.uint64)], [], 0
        for name, text in items:
            words = words_of(text.encode("utf-8", "surrogatepass"))
            if not words:
                continue
            size, hashed = min(WINDOW, len(words)), word_hashes(words)
            if size == WINDOW:
                grams = window_hashes(hashed, GRAM)
                prints.append(grams[fingerprint_places(grams, RUN)])
            ends = np.cumsum([len(w) + 1 for w in words]) + size_so_far  # one blank behind each word
            starts = np.r_[size_so_far, ends[:-1]]
            count = len(words) - size + 1
            owner = np.full(count, len(self.names), np.int32)
            for held, new in zip(parts.setdefault(size, ([], [], [], [])), (window_hashes(hashed, size), starts[:count], ends[size - 1 :] - 1, owner), strict=True):
                held.append(new)
            buffer.append(b" ".join(words) + b" ")
            size_so_far = int(ends[-1])
            self.names.append(name)
        self.text = b"".join(buffer)
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {size: Windows(*columns) for size, columns in sorted(parts.items())}

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(values), bool)
        at = np.searchsorted(known, values)
        at[at == len(known)] = 0
        return known[at] == values

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, length, item numbers) of every window that occurs in the texts of ``words``."""
        room = words.room()
        for size, known in self.windows.items():
            if size == WINDOW:
                grams, places = fingerprints(words, room)
                places = places[self._among(grams[places], self.prints)]
                starts = np.unique((places[:, None] - np.arange(RUN)).ravel())
                starts = starts[starts >= 0]
            else:
                starts = np.arange(len(words))
            starts = starts[room[starts] >= size]
            if not len(starts):
                continue
            values = windows_at(words.hashes, starts, size)
            low, high = np.searchsorted(known.hashes, values, "left"), np.searchsorted(known.hashes, values, "right")
            for i in np.flatnonzero(high > low).tolist():
                start, same = int(starts[i]), slice(low[i], high[i])
                run = words.text(start, size)
                owners = {o for b, e, o in zip(known.starts[same].tolist(), known.ends[same].tolist(), known.owners[same].tolist(), strict=True) if self.text[b:e] == run}
                if owners:
                    yield start, size, owners


def fingerprints(words: Words, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of GRAM words from each word on, and the places of those that are smallest in some run of RUN within a text.

    Grams beyond the end of a text count as the largest, so they are never chosen before one that lies within.
    """
    grams = np.full(len(words), NONE)
    inside = window_hashes(words.hashes, GRAM)
    grams[: len(inside)] = inside
    grams[room < GRAM] = NONE
    places = fingerprint_places(grams, RUN)
    return grams, places[room[places] >= GRAM]


def _matcher(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            words = Words(batch.column(batch.num_columns - 1), ALPHANUMERIC)
            marks: list[set[int]] = [set() for _ in range(batch.num_rows)]
            owners: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for start, size, who in block.hits(words):
                t = int(np.searchsorted(words.bounds, start, "right")) - 1
                at = start - int(words.bounds[t])
                marks[t].update(range(at, at + size))
                owners[t] |= who
            items = [sorted({block.names[o] for o in x if block.names[o] is not None}) for x in owners]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(words.bounds), pa.int64()), pa.array([sorted(m) for m in marks], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                [*batch.schema.names[:-1], "n_words", "hit", "items"],
            )

    return match


def _prints(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], whole: bool) -> Iterator[pa.RecordBatch]:
    """Distinct ``(row, print)`` of each ``(row, text)``: fingerprints, and hashes of windows of the shorter ``sizes``; of an item
    (``whole``) only those of its own length."""
    for batch in batches:
        words = Words(batch.column(1), ALPHANUMERIC)
        room, length = words.room(), np.repeat(np.diff(words.bounds), np.diff(words.bounds))
        owner = np.repeat(batch.column(0).to_numpy(), np.diff(words.bounds))
        found = [np.empty((0, 2), np.int64)]
        for size in sizes:
            if size == WINDOW:
                values, places = fingerprints(words, room)
            else:
                places = np.flatnonzero(room >= size)
                values = np.full(len(words), NONE)
                values[places] = windows_at(words.hashes, places, size)
            if whole:
                places = places[np.minimum(length[places], WINDOW) == size]
            found.append(np.unique(np.stack([owner[places], mixed(values[places] + np.uint64(size)).view(np.int64)], axis=1), axis=0))
        every = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(every[:, 0].copy()), pa.array(every[:, 1].copy())], ["row", "print"])


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's items, and the number of blocks that their text takes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, max(1, -(-total // BLOCK_BYTES))


def _block_of(items: DataFrame, number: int, count: int) -> Block:
    part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
    return Block((r.item, r.text) for r in part.toLocalIterator())


def _meetings(rows: DataFrame, items: DataFrame, count: int, work: Workspace) -> DataFrame:
    """Distinct ``(row, block)``: the blocks that share a fingerprint with each of ``rows(row, doc_id, text)``."""
    sizes = tuple(sorted(r.n for r in items.select(F.least(_word_count("text"), F.lit(WINDOW)).alias("n")).distinct().collect() if r.n))
    numbered = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("long").alias("row"), "text")
    theirs = work.put(numbered.mapInArrow(lambda b: _prints(b, sizes, True), "row long, print long").distinct().withColumnRenamed("row", "block"), "prints")
    ours = rows.select("row", "text").mapInArrow(lambda b: _prints(b, sizes, False), "row long, print long")
    return work.put(ours.join(theirs, "print").select("row", "block").distinct(), "meetings")


@F.arrow_udf(IntegerType())
def _word_count(column: pa.Array) -> pa.Array:
    return pa.array(np.diff(Words(column, ALPHANUMERIC).bounds), pa.int32())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    spark = docs.sparkSession
    small_batches(spark)
    key = docs.select("doc_id").schema.simpleString()[7:-1]
    items, count = _items(benchmark)
    out_type = f"{key}, n_words long, hit array<long>, items array<string>"
    match = lambda frame, number, ddl: frame.mapInArrow(_matcher(spark.sparkContext.broadcast(_block_of(items, number, count))), ddl)
    if count == 1:
        out = match(docs.select("doc_id", "text"), 0, out_type)
    else:  # rows are told apart by a number that is fixed in a written table
        with Workspace(spark, "decontaminate", keep=("hits", "sizes")) as work:
            rows = work.put(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
            meetings = _meetings(rows, items, count, work)
            parts = []
            for number in range(count):
                mine = rows.join(meetings.where(F.col("block") == number).select("row"), "row", "left_semi")
                parts.append(work.put(match(mine.select("row", "doc_id", "text"), number, f"row long, {out_type}"), f"block{number}"))
            found = reduce(DataFrame.unionByName, parts)
            # a document meets a block once: lists as many as blocks
            union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
            hits = work.put(found.groupBy("row").agg(union("hit").alias("hit"), union("items").alias("items")), "hits")
            sizes = work.put(rows.select("row", "doc_id", _word_count("text").cast("long").alias("n_words")), "sizes")
        none = F.array().cast("array<long>")
        out = sizes.join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("hit", none).alias("hit"), F.coalesce("items", none.cast("array<string>")).alias("items"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _has_hit(shared):
    @F.arrow_udf("boolean")
    def hit(column: pa.Array) -> pa.Array:
        block: Block = shared.value
        words = Words(column, ALPHANUMERIC)
        got = np.zeros(len(column), bool)
        for start, _, _ in block.hits(words):
            got[np.searchsorted(words.bounds, start, "right") - 1] = True
        return pa.array(got)

    return hit


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; rows, not ids, decide."""
    spark = docs.sparkSession
    small_batches(spark)
    items, count = _items(benchmark)
    blocks = lambda: (spark.sparkContext.broadcast(_block_of(items, n, count)) for n in range(count))
    if count == 1:
        return docs.where(~_has_hit(next(blocks()))("text"))
    with Workspace(spark, "clean", keep=("rows", "hits")) as work:
        rows = work.put(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
        narrow = rows.select("row", F.col("doc.text").alias("text"))
        meetings = _meetings(narrow, items, count, work)
        parts = []
        for number, shared in enumerate(blocks()):
            mine = narrow.join(meetings.where(F.col("block") == number).select("row"), "row", "left_semi")
            parts.append(work.put(mine.where(_has_hit(shared)("text")).select("row"), f"block{number}"))
        hits = work.put(reduce(DataFrame.unionByName, parts).distinct(), "hits")
    return rows.join(hits, "row", "left_anti").select("doc.*")


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_benchmark_decontamination": rf"""
WITH items AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
), hits AS (
  SELECT d.doc_id, d.i, d.k, t.item_id FROM doc_windows d JOIN item_windows t ON d.k = t.k AND d.g = t.g
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.list, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN marked m USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
}
