"""Column functions that the attributes share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b).otherwise(F.lit(0.0))


def safe_sqrt(a: Column) -> Column:
    return F.sqrt(F.greatest(a, F.lit(0.0)))


def truncated(a: Column) -> Column:
    """Towards zero, as a whole number."""
    return a.cast("long")


def to_pixel(row: Column, col: Column, cols: int) -> Column:
    return row * cols + col


def palette(value: Column) -> Column:
    """A colour for a number: three bytes of its hash, the same in every run."""
    return F.pmod(F.xxhash64(value), F.lit(1 << 24)).cast("int")
