"""WARC archives: segmented, chunked records written and reassembled."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import SLICE_BYTES, bounded, cut, shared_dir, slices, spread_join, table

CRLF = b"\r\n"
END = "\r\n\r\n"
RECORD = "record_type string, record_id string, page_id long, uri string, refers_to string, segment int, origin string, total_length long, block binary"


def record_id(page_id: int | None, digest: str) -> str:
    """A record identifier that depends on page and payload alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; null if its framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(CRLF, at)
        if line < 0:
            return None
        try:
            n = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = line + 2
        if n == 0:
            return b"".join(parts)
        if n < 0 or body[at + n : at + n + 2] != CRLF:
            return None
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response message, without transfer framing."""
    head, gap, body = block.partition(CRLF + CRLF)
    if not gap:
        return None
    fields = [x.split(b":", 1) for x in head.split(CRLF)[1:]]
    coded = any(f[0].strip().lower() == b"transfer-encoding" and b"chunked" in f[-1].lower() for f in fields)
    return dechunked(body) if coded else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def records(page_id: int | None, uri: str | None, payload: bytes, revisit: bool, refers: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response with its continuations."""
    digest = hashlib.sha1(payload).hexdigest()
    own = record_id(page_id, digest)
    uri = None if uri is None else "".join(c for c in uri if c not in "\r\n")
    base = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"), ("WARC-Page-ID", page_id)]
    if revisit:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own + "r"), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record([*head, *base, ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        head = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", own if k == 1 else f"{own}s{k}"), *(base if k == 1 else base[:2])]
        if k == 1:
            head.append(("Content-Type", "application/http;msgtype=response"))
        if len(parts) > 1:
            head.append(("WARC-Segment-Number", k))
            if k > 1:
                head.append(("WARC-Segment-Origin-ID", own))
            if k == len(parts):
                head.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(head, part)


def write_archive(pages: DataFrame, path: str, payload: str = "html", id_col: str = "page_id", uri: str = "url", least: int = 1000, segment: int = 16_384, chunk: int = 4096, per_file: int = 1000) -> None:
    """Write ``pages`` as gzipped WARC files of at most ``per_file`` records.

    Of equal payloads (same SHA-1 and length) of at least ``least`` bytes the
    page with the largest id is a response and the others revisit it; all
    others are responses. A null payload is empty. Blocks over ``segment`` bytes
    are split into continuation records. Repeated rows are written each; pages
    whose id is null have the id of no page and never displace another.
    """
    bounded(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    narrow = pages.select(F.col(id_col).alias("_id"), F.octet_length(body).alias("_n"), body.alias("_b")).where(F.col("_n") >= least).select("_id", F.sha1("_b").alias("_digest"), "_n")
    shared = table(narrow.groupBy("_digest", "_n").agg(F.max("_id").alias("_last"), F.count("*").alias("_c")).where("_c > 1").select(F.concat_ws(":", "_digest", "_n").alias("_same"), "_last"))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(uri).alias("_uri"), body.alias("_body"))
    rows = rows.withColumn("_same", F.when(F.octet_length("_body") >= least, F.concat_ws(":", F.sha1("_body"), F.octet_length("_body"))))
    if shared.isEmpty():
        rows = rows.withColumn("_last", F.lit(None).cast("long"))
    else:
        rows = rows.join(shared, "_same", "left")

    def run(batches):
        for batch in slices(batches, "_body"):
            out = []
            for row in batch.to_pylist():
                revisit = row["_last"] is not None and row["_id"] != row["_last"]
                out += records(row["_id"], row["_uri"], row["_body"], revisit, row["_last"], segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    text = rows.select("_id", "_uri", "_body", F.col("_last").cast("long").alias("_last")).mapInArrow(run, "record binary")
    text.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive file, plain or gzipped, by content length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(CRLF + CRLF, at)
        if stop < 0:
            return
        fields = {}
        for line in data[at:stop].split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
        n = number("content-length") or 0
        at = stop + 4 + n
        yield {
            "record_type": fields.get("warc-type"),
            "record_id": fields.get("warc-record-id"),
            "page_id": number("warc-page-id"),
            "uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"),
            "segment": number("warc-segment-number"),
            "origin": fields.get("warc-segment-origin-id"),
            "total_length": number("warc-segment-total-length"),
            "block": data[stop + 4 : at],
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files under ``path``, continuations apart."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse(content.as_py()):
                    rows.append(row)
                    size += len(row["block"])
                    if size > SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


SCHEMA = pa.schema(
    [("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total_length", pa.int64()), ("block", pa.binary())]
)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: continuations joined to the record that they continue.

    Segments are grouped by origin identifier and ordered by number. ``complete``
    is false, and the block null, unless the numbers run from 1 without a gap and
    the lengths add up to the total that the last one names. A record that was
    written several times comes out as often. A group holds one record's bytes.
    """
    plain = found.where("segment is null").withColumn("complete", F.lit(True)).drop("segment", "origin", "total_length")
    parts = found.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    piece = F.struct("segment", "total_length", "block")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = parts.groupBy("origin").agg(F.array_sort(F.collect_set(piece)).alias("p"), F.sum((F.col("segment") == 1).cast("int")).alias("copies"), *[first(c) for c in ("record_type", "page_id", "uri", "refers_to")])
    block = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    whole = groups.withColumn("block", block)
    numbers = F.transform("p", lambda x: x["segment"])
    right = (numbers == F.sequence(F.lit(1), F.size("p"))) & F.coalesce(F.octet_length("block") == F.get(F.col("p"), F.size("p") - 1)["total_length"], F.lit(False))
    whole = whole.withColumn("complete", right).withColumn("block", F.when(F.col("complete"), F.col("block")))
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    return plain.unionByName(whole.select("record_type", F.col("origin").alias("record_id"), "page_id", "uri", "refers_to", "block", "complete"))


def payloads(whole: DataFrame) -> DataFrame:
    """Add ``payload``: the body of an HTTP block, its chunked framing removed."""
    kept = [c for c in whole.columns if c != "block"]

    def run(batches):
        for batch in slices(batches, "block"):
            out = [None if b is None else payload_of(b) for b in batch.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "payload"])

    schema = ", ".join([*(f"{c} {whole.schema[c].dataType.simpleString()}" for c in kept), "payload binary"])
    return whole.select(*kept, "block").mapInArrow(run, schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: its type, payload size and digest, what it revisits.

    Columns: ``page_id``, ``uri``, ``payload_bytes``, ``payload_digest`` (SHA-1,
    hex), ``record_type``, ``refers_to`` (a page id). Of a revisit they are those
    of the payload it refers to, or null if that record is missing or broken.
    An archive without records gives no rows.
    """
    whole = payloads(reassemble(read_records(spark, path)))
    narrow = cut(whole.select("record_type", "record_id", "page_id", "uri", F.col("refers_to").alias("target"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")))
    responses = narrow.where("record_type = 'response'").select("page_id", "uri", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    targets = narrow.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = spread_join(narrow.where("record_type = 'revisit'").select("page_id", "uri", "record_type", "target"), targets, "target")
    return responses.unionByName(revisits.select(*responses.columns))


def archive_path(spark: SparkSession) -> str:
    """A new folder for an archive, in the shared one."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
