"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_to_text(value: Column) -> Column:
    """Decimal digits with a minus where needed."""
    return value.cast("string")


def radix_text(value: Column, radix: int, signed: bool = True) -> Column:
    """Upper-case digits in a radix from 2 to 36. A minus appears in radix 10 if ``signed``; all else
    shows the unsigned 64-bit view."""
    if not 2 <= radix <= 36:
        raise ValueError(f"radix {radix}")
    v = value.cast("long")
    if radix == 10 and signed:
        return v.cast("string")
    if radix == 16:
        return F.hex(v)
    if radix == 2:
        return F.bin(v)
    # conv() takes the unsigned view of a negative number but saturates at -2**63
    lowest = F.lit(_digits(1 << 63, radix))
    return F.when(v == -(1 << 63), lowest).otherwise(F.conv(v.cast("string"), 10, radix) if radix != 10 else F.conv(F.hex(v), 16, 10))


def _digits(number: int, radix: int) -> str:
    out = ""
    while number:
        number, d = divmod(number, radix)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return out or "0"
