"""Array helpers used by the sequence operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_right(array: Column, length: Column, fill: Column) -> Column:
    """``array`` extended with ``fill`` to ``length``; never shortened."""
    missing = F.greatest(length - F.size(array), F.lit(0))
    return F.concat(array, F.array_repeat(fill, missing))


def shift(array: Column, n: int | Column, fill: Column, left: bool = True) -> Column:
    """Move the elements ``n`` places, filling the freed end; the size stays."""
    size = F.size(array)
    by = F.least(F.lit(n) if isinstance(n, int) else n, size)
    kept = size - by
    if left:
        return F.concat(F.slice(array, by + 1, kept), F.array_repeat(fill, by))
    return F.concat(F.array_repeat(fill, by), F.slice(array, 1, kept))


def window_of(array: Column, start: Column, length: Column) -> Column:
    """Elements ``start .. start+length-1`` (0-based), cut at the array's end."""
    available = F.greatest(F.size(array) - start, F.lit(0))
    return F.slice(array, start + 1, F.greatest(F.least(length, available), F.lit(0)))


def zero_last(array: Column, fill: Column) -> Column:
    """The same array with its last element replaced; empty stays empty."""
    size = F.size(array)
    return F.when(size > 0, F.concat(F.slice(array, 1, size - 1), F.array(fill))).otherwise(array)


def total(array: Column) -> Column:
    """Sum of an integer array as a BIGINT."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
