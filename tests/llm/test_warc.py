import gzip
import hashlib
import random

from feedweave.llm.warc import archive_path, chunked, dechunked, parse, payload_of, read_archive, reassemble, records, write_archive

SCHEMA = "page_id long, url string, html string, block string, segment int"


def pages():
    rng = random.Random(4)
    body = lambda n: "".join(rng.choice("ab<>é\r\n ") for _ in range(n))
    big, huge = body(2000), body(90_000) + "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    out = [(i, f"http://x/{i}", body(rng.randrange(0, 3000)), "", 0) for i in range(40)]
    return out + [(100, "u", big, "", 0), (101, None, big, "", 0), (102, "u", big, "", 0), (103, "u", huge, "", 0), (99, "u", huge, "", 0), (104, "u", "s" * 999, "", 0), (105, "u", "s" * 999, "", 0), (106, "u", None, "", 0), (107, "u", "", "", 0)]


def test_framing_round_trip():
    for n in (0, 1, 4095, 4096, 9000):
        data = bytes(random.Random(n).randbytes(n))
        assert dechunked(chunked(data, 4096)) == data
    assert dechunked(b"5\r\nabc") is None and dechunked(b"zz\r\n") is None and payload_of(b"no head") is None


def test_records_split_and_parse():
    payload = b"x" * 50_000
    data = b"".join(r + b"\r\n\r\n" for r in records(7, "http://a/", payload, False, None, 16_384, 4096))
    for raw in (data, gzip.compress(data)):
        found = list(parse(raw))
        assert [f["segment"] for f in found] == [1, 2, 3, 4] and found[1]["origin"] == found[0]["record_id"]
        block = b"".join(f["block"] for f in found)
        assert found[-1]["total_length"] == len(block) and payload_of(block) == payload


def test_archive_round_trip(spark):
    data = pages()
    path = archive_path(spark)
    write_archive(spark.createDataFrame(data, SCHEMA).repartition(3), path, per_file=5)
    got = {r.page_id: r for r in read_archive(spark, path).collect()}
    last = {}
    for i, _, h, *_ in data:
        last[h or ""] = max(i, last.get(h or "", 0))
    assert len(got) == len(data)
    for i, u, h, *_ in data:
        raw, r = (h or "").encode(), got[i]
        again = len(raw) >= 1000 and last[h] != i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last[h]) if again else ("response", None))


def test_broken_segments_are_told(spark):
    whole = list(parse(b"".join(r + b"\r\n\r\n" for r in records(7, "u", b"y" * 40_000, False, None, 16_384, 4096))))
    schema = "record_type string, record_id string, page_id long, uri string, refers_to string, segment int, origin string, total_length long, block binary"
    rows = lambda parts: spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in p.values()) for p in parts], schema)
    assert reassemble(rows(whole)).first().complete
    assert reassemble(rows(whole[::-1] + whole)).count() == 2
    for parts in (whole[:-1], whole[:1] + whole[2:], whole[1:]):
        got = reassemble(rows(parts)).first()
        assert not got.complete and got.block is None


def test_no_pages_and_repeated_pages(spark):
    docs = spark.createDataFrame([(1, "u", "z" * 40_000, "", 0), (1, "u", "z" * 40_000, "", 0), (None, "u", "q", "", 0)], SCHEMA)
    path = archive_path(spark)
    write_archive(docs, path)
    assert sorted((r.page_id or 0, r.record_type) for r in read_archive(spark, path).collect()) == [(0, "response"), (1, "response"), (1, "response")]
    path = archive_path(spark)
    write_archive(docs.limit(0), path)
    assert read_archive(spark, path).count() == 0
