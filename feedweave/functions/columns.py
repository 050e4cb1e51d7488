"""Building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def search(value: Column, ranges: list[tuple]) -> Column:
    """Whether a value lies in one of some ranges, which are sorted and apart: a bisection."""
    if not ranges:
        return F.lit(False)
    middle = len(ranges) // 2
    low, high = ranges[middle]
    return F.when(value < low, search(value, ranges[:middle])).when(value > high, search(value, ranges[middle + 1 :])).otherwise(F.lit(True))
