"""Logical number types of maps, their sentinels, and their storage in Spark."""

from __future__ import annotations

from decimal import Decimal
from numbers import Integral, Real
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixelization import UNSEEN

SPARK = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "bigint",
    "float16": "float", "float32": "float", "float64": "double",
}


def is_float(dtype: str) -> bool:
    return dtype.startswith("float")


def is_integer(dtype: str) -> bool:
    return dtype.startswith(("int", "uint"))


def limits(dtype: str) -> tuple[int, int]:
    bits = int(dtype.lstrip("uint"))
    return (0, (1 << bits) - 1) if dtype[0] == "u" else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)


def check_sentinel(dtype: str, sentinel: Any = None) -> Any:
    """The sentinel, or the type's own one; one of another family or out of range raises."""
    if dtype not in SPARK:
        raise ValueError(f"no such type: {dtype}")
    if dtype == "bool":
        if sentinel not in (None, False):
            raise ValueError("the sentinel of a boolean map is False")
        return False
    if is_float(dtype):
        if sentinel is None:
            return UNSEEN
        if isinstance(sentinel, (bool, Integral)) or not isinstance(sentinel, Real):
            raise ValueError("a map of floats needs a float as sentinel")
        return float(sentinel)
    if sentinel is None:
        return limits(dtype)[0]
    if isinstance(sentinel, bool) or not isinstance(sentinel, Integral) or not limits(dtype)[0] <= sentinel <= limits(dtype)[1]:
        raise ValueError(f"a map of {dtype} needs an integer within its limits as sentinel")
    return int(sentinel)


_LOW = (1 << 32) - 1


def _joined_words(high: Column, low: Column) -> Column:
    """high * 2^32 + low modulo 2^64 as a signed long; shifts wrap where sums would raise."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _words(x: Column) -> tuple[Column, Column]:
    x = x.cast("bigint")
    return F.shiftright(x, 32), x.bitwiseAND(F.lit(_LOW))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b, or a - b, modulo 2^64."""
    (ah, al), (bh, bl) = _words(a), _words(b)
    return _joined_words(ah + bh, al + bl) if sign > 0 else _joined_words(ah - bh, al - bl)


def multiplied(a: Column, b: Column) -> Column:
    """a * b modulo 2^64: exact in decimals where the long product overflows."""
    a, b = a.cast("bigint"), b.cast("bigint")
    wide = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    turn = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    rest = F.pmod(wide, turn)
    back = F.when(rest >= F.lit(Decimal(1 << 63)), rest - turn).otherwise(rest).cast("bigint")
    return F.coalesce(F.try_multiply(a, b), back)


def total(c: Column) -> Column:
    """Aggregate: the sum modulo 2^64, as sums of two words that cannot overflow below 2^31 rows."""
    high, low = _words(c)
    return _joined_words(F.sum(high), F.sum(low))


def wrapped(x: Column, dtype: str) -> Column:
    """An integer result brought back into its type's range the way fixed-width arithmetic does; one of 64 bits is there already (see `added`, `multiplied`, `total`)."""
    bits = int(dtype.lstrip("uint"))
    if bits == 64:
        return x.cast("bigint")
    low = limits(dtype)[0]
    rest = F.pmod(x.cast("bigint"), F.lit(1 << bits))
    return F.when(rest >= F.lit(low + (1 << bits)), rest - F.lit(1 << bits)).otherwise(rest).cast(SPARK[dtype])
