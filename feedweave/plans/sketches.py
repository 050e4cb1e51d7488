"""Distinct counts that can be stored by day and feed, and merged into any total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values up to which a sketch is exact, as a power of two; beyond, its error is about
#: ``2 ** (-SIZE / 2)`` of the count (0.4 % at 16), whatever is merged.
SIZE = 16


def stored(rows: DataFrame, value: str, by: list[str], size: int = SIZE) -> DataFrame:
    """A sketch of the distinct values for each ``by``, and how many rows it saw. Nulls are not counted."""
    return rows.groupBy(*by).agg(F.theta_sketch_agg(value, size).alias("sketch"), F.count(value).alias("seen"))


def cubed(sketches: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Distinct values for every combination of ``by`` and their totals (null), by merging sketches alone."""
    return sketches.cube(*by).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", size)).alias("distinct"), F.sum("seen").alias("seen"), *[F.grouping(c).alias(f"{c}_all") for c in by])
