"""Exact deduplication with the state of a stream.

A stream reads the documents' files and keeps, for every digest, how many rows had
it and which of them stays: its identifier and its locator (file and row). The state
lives in RocksDB on the executors' disks, is checkpointed to the shared folder and
never expires, so that a later run with the same folder reads new files only. Rows
that meet a digest again are compared by all their bytes before they count as equal.

Everything is DataFrame operations; no text passes through Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import shared_dir

#: Bits of the filter that says which digests were met again: 64 to a row of the
#: broadcast table, so that it has 2**18 rows at most.
FILTER_BITS = 24
#: The state's store: on disk, with changes as checkpoints, and without room set aside for each partition.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def located(docs: DataFrame, id: str, text: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``digest``, ``place`` (identifier, file and row: what tells two rows apart) and ``body`` of rows of files."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    place = F.struct(F.col(id).alias("id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(digest(body).alias("digest"), place.alias("place"), body.alias("body"))


def follow(spark: SparkSession, path: str, folder: str, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files: int = 100_000) -> None:
    """Take in what is new under ``path`` (Parquet), ``files`` files at a time.

    ``folder`` holds the stream's checkpoint and the groups that each batch changed.
    A batch that is repeated after a failure overwrites what it wrote before. Rows of
    a digest are added up before they are shuffled, so that a hot one has a row a task.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    # a stream takes a folder, or a pattern: this one matches the one file
    pattern = f"{path[:-1]}[{path[-1]}]" if alone else path
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)
    state = located(docs, id, text, digest).groupBy("digest").agg(F.count("*").alias("n"), F.max("place").alias("keep"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The present state: ``digest``, ``n`` and ``keep``. A digest's latest version has most rows."""
    changed = spark.read.schema(f"digest binary, n bigint, keep {schema}").option("recursiveFileLookup", "true").parquet(f"{folder}/groups")
    return changed.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("g")).select("digest", "g.n", "g.keep")


def may_hold(digests: DataFrame, bits: int = FILTER_BITS) -> Callable[[DataFrame], DataFrame]:
    """A filter for rows whose digest may be among some: a bitmap of bounded size, broadcast.

    It never loses a row; the fuller it is, the more rows it lets through.
    """
    at = F.pmod(F.xxhash64("digest"), F.lit(1 << bits))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(63).cast("int")
    made = digests.select(word.alias("_word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(digest), 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))

    def keep(rows: DataFrame) -> DataFrame:
        hit = rows.withColumn("_word", word).withColumn("_at", bit).join(F.broadcast(made), "_word")
        return hit.where(F.expr("shiftrightunsigned(_bits, _at) & 1L = 1L")).drop("_word", "_at", "_bits")

    return keep


def unequal(rows: DataFrame, again: DataFrame) -> DataFrame:
    """The digests among ``again`` (met more than once) that different bodies have.

    All bytes of the rows that hit are compared: the least and the greatest body of a
    digest are equal only if all are. Tasks send one pair a digest, however many rows it has.
    """
    hits = may_hold(again)(rows)
    return hits.groupBy("digest").agg((F.min("body") != F.max("body")).alias("bad")).where("bad").select("digest")


def exact_dedup(spark: SparkSession, path: str, folder: str | None = None, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files: int = 100_000) -> DataFrame:
    """``id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row under ``path``.

    Texts are equal if their bytes are. Of equal texts the row with the largest id
    stays; of equal ids the one whose file, by hash, and row are the largest, so that exactly one row
    of a group is kept. ``folder`` (default: a new one in the shared folder) holds the state;
    with one that was used before, only new files go through the stream.

    Null texts count as empty ones. Null ids come before all others; a group of null ids
    has a null ``keep_id``. Very long texts are taken whole; the state and the shuffles of
    the groups never hold a text. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    folder = folder or f"{shared_dir(spark)}/feedweave-{uuid.uuid4().hex}"
    follow(spark, path, folder, id, text, digest, files)
    rows = located(spark.read.parquet(path), id, text, digest)
    kind = rows.schema["place"].dataType.simpleString()
    again = groups(spark, folder, kind).where("n > 1")
    found = rows.select("digest", "place", sha256(F.col("body")).alias("_sha")).join(again, "digest", "left")
    bad = unequal(rows, again.select("digest"))
    if not bad.isEmpty():
        # different texts share a digest: these rows are grouped by their bodies instead
        apart = rows.join(bad, "digest")
        by_body = apart.groupBy("digest", "body").agg(F.count("*").alias("n"), F.max("place").alias("keep"))
        others = found.join(bad, "digest", "left_anti")
        found = others.unionByName(apart.join(by_body, ["digest", "body"]).select("digest", "place", sha256(F.col("body")).alias("_sha"), "n", "keep"))
    keep = F.coalesce("keep", "place")
    return found.select(F.col("place.id").alias(id), keep["id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("place") == keep).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
