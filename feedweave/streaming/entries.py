"""Entries of streams of documents, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.options import Options
from feedweave.plans.parse import parse_entries

#: What is kept of an entry on a stream unless fields are named.
FIELDS = ("id", "title", "link", "published", "updated", "summary", "author")


def entry_key() -> Column:
    """An entry's id, else its link, else a hash of what it says."""
    return F.coalesce("id", "link", F.sha1(F.concat_ws("\x1f", "title", "summary").cast("binary")))


def new_entries(docs: DataFrame, feed: str, fetched: str, content: str = "content", delay: str = "7 days", options: Options = Options(), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The entries of a stream (or table) of documents, the first time each is seen.

    ``feed`` names the column of the feed's address, ``fetched`` that of the time
    of the fetch, on which the watermark stands: state of entries that were last
    seen ``delay`` ago is let go. On a table, which has no order of arrival, one
    row of each entry is kept.
    """
    rows = parse_entries(docs.select(feed, fetched, content), content, options, fields).withColumn("entry_key", entry_key())
    if not docs.isStreaming:
        return rows.dropDuplicates([feed, "entry_key"])
    return rows.withWatermark(fetched, delay).dropDuplicatesWithinWatermark([feed, "entry_key"])


def counts(entries: DataFrame, time: str, feed: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Entries by feed and window of time; windows close ``delay`` after their end."""
    rows = entries.withWatermark(time, delay) if entries.isStreaming else entries
    return rows.groupBy(F.window(time, width).alias("window"), feed).agg(F.count("*").alias("n"))


def part_late(spark: SparkSession, folder: str, time: str, delay: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes to write a stream's rows to ``folder/on_time`` and ``folder/late``.

    A row is late if its time lies more than ``delay`` before the latest time of the batches before:
    what a watermark of that delay lets windows drop. A batch that is repeated overwrites what it wrote,
    and judges by the same batches as before.
    """
    marks = f"{folder}/latest"

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        seen = session.createDataFrame([], f"batch bigint, latest {rows.schema[time].dataType.simpleString()}")
        if batch:
            seen = session.read.schema(seen.schema).parquet(marks).where(F.col("batch") < batch)
        latest = seen.agg(F.max("latest").alias("_latest"))
        judged = rows.crossJoin(F.broadcast(latest)).withColumn("_late", F.coalesce(F.col(time) < F.col("_latest") - F.expr(f"interval {delay}"), F.lit(False)))
        for name, wanted in (("on_time", "not _late"), ("late", "_late")):
            judged.where(wanted).drop("_late", "_latest").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        rows.agg(F.max(time).alias("latest")).select(F.lit(batch).cast("long").alias("batch"), "latest").write.mode("overwrite").parquet(f"{marks}/at={batch}")

    return write
