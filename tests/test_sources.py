import pytest
import gzip
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedweave.functions.register import register
from feedweave.plans.parse import parse_feeds
from feedweave.plans.remote import parse_urls
from feedweave.sources.fetch import MOST_REDIRECTS, Response, addresses, causes, fetch_feeds
from feedweave.streaming.entries import counts, new_entries

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import tests
FEED = b'<rss version="2.0"><channel><title>T</title><item><guid>1</guid></item></channel></rss>'


def answer(url, headers, timeout, most):
    """A transport without a network."""
    if url.endswith("/same") and headers.get("If-None-Match") == "e1":
        return Response(304)
    if url.endswith("/gone"):
        return Response(404, {}, b"no")
    if url.endswith("/away"):
        return Response(302, {"Location": "/feed"})
    if url.endswith("/inside"):
        return Response(301, {"Location": "http://169.254.169.254/"})
    if "/loop" in url:
        return Response(302, {"Location": url + "x"})
    if url.endswith("/boom"):
        raise OSError("reset") from ValueError("cause")
    return Response(200, {"Content-Encoding": "gzip", "ETag": "e2", "Last-Modified": "now", "Content-Type": "text/xml"}, gzip.compress(FEED))


def test_fetching(spark):
    paths = ["feed", "same", "gone", "away", "inside", "loop", "boom"]
    rows = [(f"http://example.com/{p}", "e1", "m") for p in paths] + [("http://localhost/feed", None, None), (None, None, None)]
    urls = spark.createDataFrame(rows, "url string, tag string, since string")
    got = {r.url: r for r in fetch_feeds(urls, etag="tag", modified="since", transport=answer, partitions=3).collect()}
    at = lambda p: got[f"http://example.com/{p}"]
    assert (at("feed").status, at("feed").etag, at("feed").modified, at("feed").body) == (200, "e2", "now", bytearray(FEED))
    assert (at("same").status, at("same").etag, at("same").modified, at("same").body) == (304, "e1", "m", None)
    assert (at("away").status, at("away").href) == (200, "http://example.com/feed")
    assert "404" in at("gone").fetch_error and "not allowed" in at("inside").fetch_error and str(MOST_REDIRECTS) in at("loop").fetch_error
    assert at("boom").fetch_error == "reset: cause" and "not allowed" in got["http://localhost/feed"].fetch_error and got[None].status is None
    parsed = parse_feeds(fetch_feeds(urls, transport=answer).where("body is not null").select("url", F.col("body").alias("content")))
    assert {r.feed.title for r in parsed.collect()} == {"T"}


def test_private_addresses_are_dropped():
    try:
        addresses("127.0.0.1", 80)
    except OSError as e:
        assert "no public address" in causes(e)
    else:
        raise AssertionError


def test_new_entries_of_a_stream(spark, tmp_path):
    item = lambda *ids: b'<rss version="2.0"><channel><title>T</title>' + b"".join(b"<item><guid>%d</guid></item>" % i for i in ids) + b"</channel></rss>"
    rows = [("f", "2024-01-01 00:00:00", bytearray(item(1, 2))), ("f", "2024-01-01 01:00:00", bytearray(item(2, 3))), ("g", "2024-01-01 01:00:00", bytearray(item(1)))]
    table = spark.createDataFrame(rows, "feed string, fetched string, content binary").withColumn("fetched", F.col("fetched").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = new_entries(stream, "feed", "fetched").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.feed, r.entry_key) for r in spark.table("seen").collect())
    assert got == [("f", "1"), ("f", "2"), ("f", "3"), ("g", "1")]
    assert sorted((r.feed, r.entry_key) for r in new_entries(table, "feed", "fetched").collect()) == got
    assert counts(new_entries(table, "feed", "fetched"), "fetched", "feed").agg(F.sum("n")).first()[0] == 4


def test_parsing_of_addresses(spark):
    rows = [("http://example.com/feed", None), ("http://example.com/same", "e1"), ("http://example.com/gone", None)]
    urls = spark.createDataFrame(rows, "url string, tag string")
    got = {r.url.rsplit("/", 1)[1]: r for r in parse_urls(urls, etag="tag", transport=answer, partitions=2, feed_fields=("title",)).collect()}
    assert (got["feed"].feed.title, got["feed"].etag, got["feed"].bozo, got["feed"].error) == ("T", "e2", False, None)
    assert (got["same"].status, got["same"].feed.title, got["same"].etag, got["same"].error, got["same"].bozo) == (304, None, "e1", None, False)
    assert "404" in got["gone"].error


def test_functions_in_sql(spark):
    assert "sanitize_html" in register(spark)
    row = spark.sql("select sanitize_html('<b>x</b><script>1</script>') a, is_safe_url('http://localhost/') b, resolve_url('y', 'http://e.com/x') c, detect_format(cast('<rss/>' as binary)) d").first()
    assert tuple(row) == ("<b>x</b>", False, "http://e.com/y", "rss20")


def test_bodies_are_bounded_while_they_are_inflated():
    import gzip
    import time
    import tracemalloc
    import zlib

    from feedweave.sources import fetch

    small = gzip.compress(b"a") + gzip.compress(b"b")
    assert fetch.unpacked(small, "gzip", 2) == b"ab" and fetch.unpacked(zlib.compress(b"xy"), "deflate", 2) == b"xy"
    raw = zlib.compressobj(wbits=-15)
    assert fetch.unpacked(raw.compress(b"xy") + raw.flush(), "deflate", 2) == b"xy" and fetch.unpacked(b"xy", "", 2) == b"xy"
    bomb, zeros = zlib.compressobj(9, wbits=31), bytes(1 << 20)
    packed = b"".join(bomb.compress(zeros) for _ in range(1024)) + bomb.flush()
    assert len(packed) < 2 << 20
    tracemalloc.start()
    for body, coding in ((packed, "gzip"), (packed[:-9], "gzip"), (small, "gzip"), (b"abc", "")):
        with pytest.raises(ValueError):
            fetch.unpacked(body, coding, 4 << 20 if body[:100] == packed[:100] else 1)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
    with pytest.raises(EOFError):
        fetch.unpacked(small[:-3], "gzip", 100)
    # a server that sends a byte at a time does not hold a task longer than the whole request may take
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        fetch.received(lambda n: time.sleep(0.02) or b"x", lambda s: None, began + 0.2, 1 << 20)
    assert time.monotonic() - began < 1
    assert fetch.received(lambda n: b"x" * n, lambda s: None, began + 9, 100) == b"x" * 101


def test_the_deadline_is_for_all_hops():
    import time

    from feedweave.sources.fetch import Response, fetch

    def slow(url, headers, timeout, most):
        time.sleep(0.1)
        return Response(302, {"Location": url + "x"})

    row = fetch("http://example.com/", None, None, slow, "a", 0.25, 100, {})
    assert "too long" in row["fetch_error"]


def test_answers_go_on_many_at_once_bounded_by_bytes_and_time(spark, monkeypatch):
    import pyarrow as pa

    from feedweave.sources import fetch

    def sized(url, headers, timeout, most):
        return Response(200, {"Location": "x"}, b"x" * int(url.rsplit("/", 1)[1]))

    urls, runs = spark.createDataFrame([], "n int, url string"), []
    monkeypatch.setattr(type(urls), "mapInArrow", lambda self, run, schema: runs.append(run))
    fetch_feeds(urls, transport=sized)

    def batches(sizes):
        asked = [None if s is None else f"http://example.com/{s}" for s in sizes]
        found = list(runs[0](iter([pa.RecordBatch.from_pydict({"n": pa.array(range(len(sizes)), pa.int32()), "url": pa.array(asked, pa.string())})])))
        rows = [r for b in found for r in b.to_pylist()]
        assert [(r["n"], r["url"]) for r in rows] == list(enumerate(asked)) and [r["body"] if r["body"] is None else len(r["body"]) for r in rows] == sizes
        return [b.num_rows for b in found]

    monkeypatch.setattr(fetch, "BATCH_SECONDS", 60.0)
    assert batches([5, None, 0] * 1000) == [3000]
    assert batches([600_000, 400_000, None, 600_000, 3 << 20, 7, None, 7]) == [3, 1, 1, 3]
    assert batches([]) == []
    monkeypatch.setattr(fetch, "BATCH_SECONDS", 0.0)  # slow hosts: none waits for others
    assert batches([5, None, 5]) == [1, 1, 1]
