"""Target-distribution importance resampling over hashed word n-grams.

Every feature (a run of one to three words) falls into a bucket. The buckets of the
documents are written once, as streams of packed 16-bit numbers with the offsets of
the documents in them. Streams are sorted and run-length encoded to count buckets;
the log ratio of target to source counts is a bucket's gain; a document's weight is
the sum of its features' gains. Seeded Gumbel noise turns the highest scores into a
draw without replacement, in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import bounded, cut, id_text, offsets, slices, table

BUCKETS = 10_000
#: Upper case becomes lower case; all of ASCII but letters and digits separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bits of a row's place in its partition, in Spark's increasing ids.
_PLACE = (1 << 33) - 1


def features(text: bytes) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its runs of one to three words.

    CRC-32 can be carried on, so a run's is that of the run without its last word,
    continued by a space and that word.
    """
    words = text.translate(_WORDS).split()
    tails = [b" " + w for w in words]
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, tails[1:], one))
    three = list(map(zlib.crc32, tails[2:], two))
    return len(words), (np.array(one + two + three, np.uint32) % BUCKETS).astype(np.uint16)


def streams(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents: ``ids``, ``n_words``, ``ends`` (where each document's part
    of the stream ends, in features) and ``stream`` (buckets, two bytes each, little endian)."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [features(t) for t in batch.column("_text").to_pylist()]
            ids = batch.column("_id")
            whole = pa.array([0, len(ids)], pa.int32())
            ends = offsets(len(b) for _, b in found)[1:]
            packed = np.concatenate([b for _, b in found]).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, ids), pa.array([[n for n, _ in found]], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([packed])], names=["ids", "n_words", "ends", "stream"])

    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<{kind}>, n_words array<bigint>, ends array<bigint>, stream binary")


def counts(blocks: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the streams.

    A stream is sorted and run-length encoded; a task adds the runs of its streams up,
    so that it sends at most a row for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch.column("stream").to_pylist():
                ordered = np.sort(np.frombuffer(packed, "<u2"), kind="stable")
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
                sums[ordered[starts]] += np.diff(np.r_[starts, len(ordered)])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    found = np.zeros(BUCKETS, np.int64)
    for r in blocks.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``_id``, ``n_words``, ``n_features`` and ``weight`` of each document in the blocks."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends = np.array(batch.column("ends")[k].as_py(), np.int64)
                starts = np.r_[0, ends[:-1]]
                total = np.zeros(len(ends), np.int64)
                some = np.flatnonzero(ends > starts)
                if len(some):
                    total[some] = np.add.reduceat(shared.value[np.frombuffer(batch.column("stream")[k].as_py(), "<u2")], starts[some])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("n_words")[k].values, pa.array(ends - starts), pa.array(total)], names=["_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"_id {kind}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... for the first ``most`` in the order, null for the others.

    Rows are sorted over all partitions; a row's rank is its place in its partition,
    which Spark's increasing ids hold, and the number of rows in those before it.
    """
    ordered = cut(rows.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(_PLACE)
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    before = offsets(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (part + 1).cast("int"))
    rank = start + place + 1
    return ordered.withColumn("rank", F.when(rank <= most, rank)).drop("_at")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least: int = 20, seed: int = 42, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document.

    ``share`` (numerator, denominator) of the documents with at least ``least`` words is
    drawn, rounded down; ``rank`` is null for the others. Ties go to the smaller id.

    Null and empty texts have no features and a weight of 0; a null id counts as the
    empty text in the noise and comes first in ties. Very long texts are taken whole.
    Repeated rows each have a row of their own. An empty target leaves the source's
    counts alone to decide; no documents give no rows. Other columns are ignored,
    whatever their names. What is broadcast is a number for each bucket.
    """
    blocks = table(streams(docs, id, text))
    source, aim = counts(blocks), counts(streams(target.select(F.lit(0).alias("_none"), F.col(text)), "_none", text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text("_id")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weights(blocks, gains(source, aim)).withColumn("score", F.col("weight") + noise).withColumn("_no", F.col("n_words") < least)
    n = blocks.select(F.sum(F.size(F.filter("n_words", lambda w: w >= least)))).first()[0] or 0
    found = ranked(rows, [F.col("_no"), F.col("score").desc(), F.col("_id")], share[0] * n // share[1])
    return found.select(F.col("_id").alias(id), "n_words", "n_features", "weight", "score", "rank")
