"""Sharding by proportional stratified interleaving, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedweave.llm.common import cut, id_text

#: Rows that one window group is meant to hold.
BIN_ROWS = 2048


def shuffle_key(column: str, seed: int, block: Column | None = None) -> Column:
    """A seeded number below 2**60 from an id; equal in any SQL engine with MD5."""
    salt = [F.lit(f"{seed}:")] if block is None else [F.lit(f"{seed}:"), block.cast("string"), F.lit(":")]
    return F.conv(F.substring(F.md5(F.concat(*salt, id_text(column)).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(rows: DataFrame, group: list[str], position: Column, bins: int, order: list[Column], rank: str, total: str) -> DataFrame:
    """Add the 0-based rank within ``group`` by ``order``, and the group's size.

    ``position`` in [0, 1) must not fall as ``order`` rises. Rows are dealt into
    ``bins`` by it; a running sum over the bins' counts, and a window inside
    each bin, give the rank, so a hot group is spread over many tasks.
    """
    rows = rows.withColumn("_bin", F.floor(position * bins).cast("long"))
    counts = rows.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*group)
    before = by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by).alias(total))
    inside = Window.partitionBy(*group, "_bin").orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(inside))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_bin") == F.col("_b")]
    joined = rows.join(counts, on, "inner")
    return joined.withColumn(rank, F.col("_before") + F.col("_in") - 1).drop("_bin", "_b", "_before", "_in", *[f"_{c}" for c in group])


def interleave(docs: DataFrame, shards: int = 24, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 7, payload: list[str] | None = None) -> DataFrame:
    """Cut ``docs`` into shards that each match the mixture of sources.

    Rows of a source are put into a seeded random order; a row's fractional
    rank is its place over the source's size. All rows, sorted by that, are cut
    into ``shards`` runs whose counts differ by at most one, so that each holds
    every source in proportion. Returns ``payload`` (default: the id, source and
    text checksum), ``shard`` and ``slot``, gapless from 0 within a shard.

    A null source is a source of its own and a null id hashes as the empty
    text. Ties are broken by id and text checksum; rows equal in those are
    interchangeable. Repeated rows each get a place. An empty table gives an
    empty result. Only the payload, id, source and text are read.
    """
    keep = payload or [id_col, source]
    base = docs.select(*dict.fromkeys([*keep, id_col, source]), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_bytes"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"), shuffle_key(id_col, seed).alias("_key"))
    base = cut(base)
    n = base.count()
    bins = max(1, min(1 << 20, n // BIN_ROWS))
    ties = ["_key", id_col, "_crc"]
    first = ranked(base, [source], F.col("_key") / F.lit(float(1 << 60)), bins, [F.col(c) for c in ties], "_rank", "_of")
    placed = first.withColumn("_at", (2 * F.col("_rank") + 1) / (2 * F.col("_of")))
    placed = placed.withColumn("_all", F.lit(0))
    order = [F.col("_at"), F.col(source), *[F.col(c) for c in ties]]
    whole = ranked(placed, ["_all"], F.col("_at"), bins, order, "_row", "_total")
    size, more = n // shards, n % shards
    edge = more * (size + 1)
    row = F.col("_row")
    late = row - edge
    shard = F.when(row < edge, F.floor(row / (size + 1))).otherwise(more + F.floor(late / max(size, 1)))
    slot = F.when(row < edge, row % (size + 1)).otherwise(late % max(size, 1))
    return whole.select(*keep, F.col("_bytes"), F.col("_crc"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
