"""Entries in time: what was last known then, what is near, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(_micros(time) / (seconds * 1_000_000))


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], bucket: int = 86_400) -> DataFrame:
    """``left`` with ``values`` and ``right_time`` of the last row of ``right``, by ``on``, at or before each row's time.

    Time is cut into buckets of so many seconds, so that a key of any size is dealt over many
    tasks: inside a bucket the last row is carried along in order, and what was last
    when it began comes from the last rows of the buckets before. Of rows of one time the one with the
    largest values counts. Rows without a key or a time, and those before any of ``right``, get nulls.
    """
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    keys = [f"_k{i}" for i in range(len(on))]
    held = F.struct(F.col(right_time).alias("time"), F.struct(*values).alias("values"))
    lefts = left.select(*key, F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_held"))
    rights = right.dropna(subset=[*on, right_time]).select(*key, F.col(right_time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), held.alias("_held"))
    both = lefts.unionByName(rights).withColumn("_b", _bucket("_t", bucket))
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_now", F.last("_held", ignorenulls=True).over(inside)).where("_side = 1")
    # a row per key and bucket; partial sums come before the shuffle
    ends = both.groupBy(*keys, "_b").agg(F.max("_held").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_then", F.last("_end", ignorenulls=True).over(before)).where(F.col("_then").isNotNull()).drop("_end")
    found = filled.join(starts.hint("merge"), [*keys, "_b"], "left").withColumn("_r", F.coalesce("_now", "_then"))
    return found.select("_left.*", F.col("_r.time").alias(right_time), *[F.col(f"_r.values.`{v}`").alias(v) for v in values])


def near(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, before: int, after: int) -> DataFrame:
    """All pairs of rows with equal ``on`` where ``right`` is at most ``before`` seconds earlier and ``after`` later.

    Each row of ``right`` is met in its own bucket only, each of ``left`` in all buckets that its
    interval touches, which are two if it lies across a border, since a bucket is as wide as the interval.
    Neither side is broadcast: the planner takes parsed entries for far fewer than they are.
    """
    width = max(1, before + after)
    edge = lambda shift: F.floor((_micros(left_time) + shift * 1_000_000) / (width * 1_000_000))
    lefts = left.where(F.col(left_time).isNotNull()).withColumn("_b", F.explode(F.array_distinct(F.array(edge(-before), edge(after)))))
    rights = right.where(F.col(right_time).isNotNull()).withColumn("_b", _bucket(right_time, width))
    apart = _micros(right_time) - _micros(left_time)
    return lefts.join(rights.hint("merge"), [*on, "_b"]).where(apart.between(-before * 1_000_000, after * 1_000_000)).drop("_b")


def sessions(entries: DataFrame, time: str, keys: list[str], gap: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Runs of entries with less than ``gap`` between neighbours: keys, ``start``, ``end`` (of the last entry, and the gap) and ``n``.

    On a stream a session is given when the watermark, ``delay`` behind the latest entry, has passed its end.
    """
    rows = entries.withWatermark(time, delay) if entries.isStreaming else entries
    return rows.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
