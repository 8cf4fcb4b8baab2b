"""Delta and variable-length coding of neighbour lists, as column expressions.

Differences are taken modulo 2**32; a number is written in groups of 7 bits, the lowest first, with
the top bit set on all bytes but the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from hoplite.schema import U32

_LONGS = "array<bigint>"


def _byte(x: Column) -> Column:
    """Two hex digits of a number below 256."""
    return F.lpad(F.hex(x), 2, "0")


def varint_length(value: Column) -> Column:
    """Bytes that a number below 2**32 takes."""
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


def varint_hex(value: Column) -> Column:
    """A number's code as hex text."""
    v = value.cast("long")
    group = lambda i: F.shiftrightunsigned(v, 7 * i).bitwiseAND(F.lit(127))
    parts = [_byte(group(i)) if last else _byte(group(i).bitwiseOR(F.lit(128))) for i, last in ((0, False), (1, False), (2, False), (3, False), (4, True))]
    ends = [_byte(group(i)) for i in range(5)]
    codes = [F.concat(*parts[:n], ends[n]) for n in range(5)]
    return F.when(v < 1 << 7, codes[0]).when(v < 1 << 14, codes[1]).when(v < 1 << 21, codes[2]).when(v < 1 << 28, codes[3]).otherwise(codes[4])


def encode_varint(value: Column) -> Column:
    return F.unhex(varint_hex(value))


def deltas(numbers: Column) -> Column:
    """Differences to the number before (the first to 0), modulo 2**32."""
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))))
    return F.when(F.size(numbers) == 0, F.array().cast(_LONGS)).otherwise(F.zip_with(numbers, before, lambda x, y: F.pmod(x - y, F.lit(U32))))


def undeltas(differences: Column) -> Column:
    """Running sums modulo 2**32."""
    return _sums()(differences)


def compressed_hex(numbers: Column) -> Column:
    """A list's code as hex text; empty for an empty list."""
    return F.array_join(F.transform(deltas(numbers), varint_hex), "")


def compressed(numbers: Column) -> Column:
    return F.unhex(compressed_hex(numbers))


def compressed_length(numbers: Column) -> Column:
    """Bytes of a list's code, without making it."""
    return F.aggregate(F.transform(deltas(numbers), varint_length), F.lit(0).cast("long"), lambda s, n: s + n)


def decode_varints(code: Column) -> Column:
    """All numbers of a code; bits above 32 fall away, an unfinished last number is left out."""
    return _numbers(False)(code)


def decompressed(code: Column) -> Column:
    return _numbers(True)(code)


# Column expressions have no running state within an array but `aggregate`, which copies the list that it builds at every
# element; so the inverse direction works on Arrow batches, in time linear in their bytes.


def _lists(ends: np.ndarray, values: np.ndarray, like: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()), mask=pa.array(like.is_null()) if like.null_count else None)


def _running(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums modulo 2**32 that start anew at each list."""
    sums = np.r_[np.uint64(0), np.cumsum(values.astype(np.uint64), dtype=np.uint64)]
    return ((sums[1:] - np.repeat(sums[ends[:-1]], np.diff(ends))) % U32).astype(np.int64)


def _sums():
    @F.arrow_udf(_LONGS)
    def sums(column: pa.Array) -> pa.Array:
        ends = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())]
        values = column.flatten().to_numpy(zero_copy_only=False) % U32
        return _lists(ends, _running(values, ends), column)

    return sums


def decoded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codes that lie in ``data`` between ``ends``, and the ends of their lists."""
    stops = np.flatnonzero(data < 128)
    owner = np.searchsorted(ends, stops, "right") - 1
    starts = np.maximum(np.r_[0, stops[:-1] + 1], ends[owner]) if len(stops) else stops
    number = np.cumsum(data < 128) - (data < 128)  # the number that a byte belongs to, if it is not behind the last one
    place = np.arange(len(data)) - np.r_[starts, len(data)][number]
    value = np.where((place >= 0) & (place < 5), (data & 127).astype(np.int64) << (7 * np.clip(place, 0, 4)), 0)
    values = np.add.reduceat(value, starts) % U32 if len(starts) else np.empty(0, np.int64)
    return values, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(ends) - 1))]


def _numbers(summed: bool):
    @F.arrow_udf(_LONGS)
    def numbers(column: pa.Array) -> pa.Array:
        raw = [x or b"" for x in column.to_pylist()]
        values, ends = decoded(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
        return _lists(ends, _running(values, ends) if summed else values, column)

    return numbers
