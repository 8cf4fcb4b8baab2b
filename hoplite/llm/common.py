"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: long texts must not add up to gigabytes in one.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of a text that are cut into words at a time.
SLICE_BYTES = 1 << 20

#: Odd 64-bit multipliers that weigh the words of a window, and those of the final mix (fixed values).
WINDOW_ODD = (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
    0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold. Plans read these settings when they run, which for a result that the caller computes later is
    after we have returned; so the session keeps them, and a smaller bound of the caller's own stays."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or int(now) == 0 or int(now) > bound:
            spark.conf.set(key, str(bound))


def slices(text: bytes, ends: bytes = b" \n", size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes that end behind one of ``ends``, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(bytes([e]), at, at + size) for e in ends)
        if cut < 0:
            cut = min((c for e in ends if (c := text.find(bytes([e]), at + size)) >= 0), default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    if at < len(text) or not at:
        yield text[at:] if at else text


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_LAST_BYTES = np.array([*((1 << 8 * i) - 1 for i in range(8)), (1 << 64) - 1], np.uint64)
_STEP = np.uint64(WINDOW_ODD[0])


def _run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, eight bytes of all runs at a time; ``data`` has eight bytes more than the runs.

    Runs of equal length up to eight bytes never share a hash, as every step can be undone.
    """
    words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    h = sizes.astype(np.uint64) * _STEP
    at, left, live = starts, sizes, slice(None)
    while len(at):
        x = (h[live] ^ (words[at] & _LAST_BYTES[np.minimum(left, 8)])) * _STEP
        h[live] = x ^ (x >> np.uint64(29))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return mixed(h)


def word_hashes(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return _run_hashes(np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.cumsum(sizes) - sizes, sizes)


#: Each byte with A-Z in lower case; whether it belongs to a word between white space, and to one of letters, digits and non-ASCII characters.
FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
SPACED = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
ALPHANUMERIC = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in FOLDED.tolist()])


class Words:
    """The words of all texts of an Arrow string column, A-Z in lower case, without an object for each.

    Word i has the hash ``hashes[i]``; the words of text t are those from ``bounds[t]`` to ``bounds[t + 1]``. Null texts have none.
    """

    def __init__(self, column: pa.Array, in_word: np.ndarray = SPACED):
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, places, values = column.buffers()
        at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if places else np.zeros(len(column) + 1, np.int64)
        raw = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values else np.empty(0, np.uint8)
        at = at - at[0]
        self.data = np.zeros(len(raw) + 8, np.uint8)
        self.data[: len(raw)] = FOLDED[raw]
        word = in_word[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        begins, ends = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
        first[begins], last[ends] = word[begins], word[ends]  # words end with their text
        self.starts = np.flatnonzero(first)
        self.sizes = np.flatnonzero(last) + 1 - self.starts
        self.bounds = np.searchsorted(self.starts, at)
        self.hashes = _run_hashes(self.data, self.starts, self.sizes)

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int, count: int = 1) -> bytes:
        """Words from the i-th on, with one blank between them."""
        return b" ".join(self.data[self.starts[j] : self.starts[j] + self.sizes[j]].tobytes() for j in range(i, i + count))

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * np.uint64(WINDOW_ODD[0])
    for i in range(1, k):
        out += h[i : i + n] * np.uint64(WINDOW_ODD[i])
    return mixed(out + np.uint64(k))


def windows_at(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words that begin at ``starts``; as `window_hashes` has them."""
    out = h[starts] * np.uint64(WINDOW_ODD[0])
    for i in range(1, k):
        out += h[starts + i] * np.uint64(WINDOW_ODD[i])
    return mixed(out + np.uint64(k))


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema, strict=True)], schema=schema)


def sampled(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by the hash of ``key``: the same on every run."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / total)))
