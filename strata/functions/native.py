"""Common user functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def square(x: Column) -> Column:
    return x * x


def difference(a: Column, b: Column) -> Column:
    return a - b


def clamp(x: Column, low: float = -10, high: float = 10) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def rms(total: Column, number: Column) -> Column:
    """Square root of the mean; null without any cells."""
    return F.when(number > 0, F.sqrt(total / number))


def conjunction(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def ordinal_text(number: Column, name: str = "John the") -> Column:
    return F.format_string(f"{name} %dth", number)


def date_text(ts: Column) -> Column:
    """``Mon Jan 05 10:00:00 2026``."""
    return F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy")


def elementwise_sum(a: Column, b: Column) -> Column:
    """Sums of the elements that both arrays have."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x + y)


def repeat(x: Column, n: Column | int) -> Column:
    return F.array_repeat(x, n)


def array_sum(a: Column, kind: str = "double") -> Column:
    """Sum of the elements, as ``kind``; 0 for an empty array."""
    return F.aggregate(a, F.lit(0).cast(kind), lambda total, x: total + x.cast(kind))


def square_sum(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda total, x: total + x.cast(kind) * x.cast(kind))


def vector_add(a: Column, b: Column, fields=("x", "y", "z")) -> Column:
    return F.struct(*((a[f] + b[f]).alias(f) for f in fields))


def vector_subtract(a: Column, b: Column, fields=("x", "y", "z")) -> Column:
    return F.struct(*((a[f] - b[f]).alias(f) for f in fields))


def unsigned_sum(a: Column, b: Column, bits: int = 32) -> Column:
    """Sum that wraps as unsigned integers of so many bits do (up to 32, in a wider type)."""
    return F.pmod(a.cast("long") + b.cast("long"), F.lit(1 << bits))
