"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whole texts travel to Python in slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: Bits of the filters that thin out rows before a shuffle: 16 for each hash in
#: them, up to 2**FILTER_BITS (32 MB). A full one lets more rows through, and never
#: loses one.
FILTER_BITS = 28
#: Words of a filter that a task puts together (2 MB).
FILTER_BLOCK = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session, as in
    tests, gets a temporary folder; a cluster has none that could serve, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='feedweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def bounded(spark: SparkSession) -> None:
    """Keep what goes to Python at once small where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except ValueError:
        now = -1
    if not 0 < now <= 2 * SLICE_BYTES:
        spark.conf.set(key, str(2 * SLICE_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, **options: str) -> DataFrame:
    """Like :func:`cut`, but as Parquet, whose size the planner then knows."""
    return Scratch(df.sparkSession).table(df, **options)


class Scratch:
    """Tables in the shared folder that go together, once all that reads them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/feedweave-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Remove the tables, and have Spark remove the shuffles that only they needed."""
        context = self.spark.sparkContext
        for path in self.paths:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        self.paths.clear()
        gc.collect()
        context._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def id_text(column: str) -> Column:
    """An id as text for hashing; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, n: int) -> Column:
    """CRC-32 of an id, as text, modulo ``n``."""
    return F.crc32(id_text(column).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_BYTES`` of a binary column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > SLICE_BYTES:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n
        if first < len(lengths):
            yield batch.slice(first)


def offsets(counts: Iterable[int]) -> list[int]:
    """Start of each run of the given lengths, and the end of the last."""
    return [0, *accumulate(counts)]


def replicas(n: int) -> Column:
    """The numbers below ``n``, one row each."""
    return F.explode(F.array(*[F.lit(i) for i in range(n)]))


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", salt: Column | None = None, ways: int = 8) -> DataFrame:
    """Join a side with hot keys to a side with one row per key.

    Rows of the hot side are dealt over ``ways`` partitions per key; the other
    side is copied that many times.
    """
    salt = F.pmod(F.xxhash64(*(left.columns if salt is None else [salt])), F.lit(ways)).cast("int")
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", replicas(ways)), [on, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The root (smallest node) of every node with a link, as ``(node, root)``.

    ``edges`` has two columns of one orderable type. Alternates large-star and
    small-star rounds, which need a number of rounds that is logarithmic in the
    size of a component, and never holds a component in one task.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, with the place of the first."""
    texts = [t or b"" for t in batch.column("_text").to_pylist()]
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, back)]
    return _powers[0], _powers[1]


class Filter:
    """A bitmap by the leading bits of 64-bit hashes.

    It comes to the driver as blocks of bytes that tasks have put together, a part at a time: as rows of
    words a full one would take many times its size there.
    """

    def __init__(self, hashes: DataFrame, column: str):
        self.bits, n = 16, hashes.count()
        while self.bits < FILTER_BITS and 1 << self.bits < 16 * n:
            self.bits += 1
        place = f"shiftrightunsigned({column}, {64 - self.bits})"
        bit = F.expr(f"shiftleft(1L, cast({place} & 63 as int))")
        words = hashes.groupBy(F.expr(f"shiftright({place}, 6)").alias("w")).agg(F.bit_or(bit).alias("b"))
        self.words = np.zeros(1 << self.bits - 6, np.uint64)
        size = min(FILTER_BLOCK, len(self.words))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Words in order; a block's come one after the other, from one batch to the next too."""
            block, body = -1, np.zeros(size, np.uint64)

            def put_together():
                return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([body.tobytes()])], names=["block", "body"])

            for batch in batches:
                at, bits = (batch.column(c).to_numpy() for c in ("w", "b"))
                for k in np.unique(at // size).tolist():
                    if k != block:
                        if block >= 0:
                            yield put_together()
                        block, body = k, np.zeros(size, np.uint64)
                    own = at // size == k
                    body[at[own] % size] = bits[own].view(np.uint64)
            if block >= 0:
                yield put_together()

        parts = max(1, len(self.words) // size)
        dealt = words.repartitionById(parts, F.floor(F.col("w") / size).cast("int")) if parts > 1 else words.coalesce(1)
        for row in dealt.sortWithinPartitions("w").mapInArrow(put, "block bigint, body binary").toLocalIterator():
            at = row["block"] * size
            self.words[at : at + size] = np.frombuffer(row["body"], np.uint64)

    def __contains__(self, h: int) -> bool:
        at = h >> 64 - self.bits
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return np.flatnonzero(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
