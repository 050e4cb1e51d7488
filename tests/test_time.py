"""As-of and interval joins, sessions, late rows, polling state and merged sketches."""

import bisect
import os
import random
import time
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedweave.plans.sketches import cubed, stored
from feedweave.plans.timeline import as_of, near, sessions
from feedweave.sources.fetch import Response
from feedweave.streaming.entries import part_late
from feedweave.streaming.polling import poll, use_rocksdb

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def moment(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def rows(spark, data, names):
    return spark.createDataFrame([(k, moment(t), v) for k, t, v in data], f"{names[0]} string, {names[1]} timestamp, {names[2]} int").repartition(4)


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aaaaab") if rng.random() < 0.95 else None, rng.randrange(0, 40_000, 7) if rng.random() < 0.97 else None, rng.randrange(100)) for _ in range(n)]


@pytest.mark.parametrize("bucket", [60, 3600, 10**9])
def test_as_of(spark, bucket):
    left, right = made(600, 1), made(200, 2)
    got = as_of(rows(spark, left, ("k", "t", "n")), rows(spark, right, ("k", "at", "v")), ["k"], "t", "at", ["v"], bucket)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    by = defaultdict(list)
    for k, t, v in right:
        if t is not None:
            by[k].append((t, v))
    want = []
    for k, t, n in left:
        held = sorted(by[k]) if k is not None and t is not None else []
        i = bisect.bisect_right(held, (t, 1000)) if held else 0
        want.append((k, t, n, *(held[i - 1] if i else (None, None))))
    seconds = lambda x: None if x is None else int((x.replace(tzinfo=timezone.utc) - START).total_seconds())
    assert sorted(((r.k, seconds(r.t), r.n, seconds(r["at"]), r.v) for r in got.collect()), key=str) == sorted(want, key=str)


def test_near(spark):
    left, right = made(300, 3), made(300, 4)
    got = near(rows(spark, left, ("k", "t", "n")), rows(spark, right, ("k", "at", "v")), ["k"], "t", "at", 100, 50)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    want = [(k, n, v) for k, t, n in left for k2, at, v in right if None not in (k, t, at) and k == k2 and -100 <= at - t <= 50]
    assert sorted((r.k, r.n, r.v) for r in got.collect()) == sorted(want) and want


def test_sessions(spark):
    data = [x for x in made(300, 5) if x[1] is not None]
    by, want = defaultdict(list), []
    for k, t, _ in data:
        by[k].append(t)
    for k, times in by.items():
        times.sort()
        run = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t - run[-1] >= 120:
                want.append((k, run[0], run[-1] + 120, len(run)))
                run = []
            run.append(t)
    seconds = lambda x: int((x.replace(tzinfo=timezone.utc) - START).total_seconds())
    got = sessions(rows(spark, data, ("k", "t", "n")), "t", ["k"], "2 minutes").collect()
    assert sorted(((r.k, seconds(r.start), seconds(r.end), r.n) for r in got), key=str) == sorted(want, key=str)


def test_sessions_and_late_rows_of_a_stream(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [[("a", 0, 1), ("a", 50, 2), ("b", 10, 3)], [("a", 5000, 4), ("b", 4900, 5), ("b", None, 9)], [("a", 60, 6), ("a", 4400, 7), ("b", 5100, 8)], [("a", 90_000, 10)]]
    for i, data in enumerate(batches):
        rows(spark, data, ("k", "t", "n")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t timestamp, n int").parquet(source)
        stream.writeStream.foreachBatch(part_late(spark, out, "t", "10 minutes")).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
        found = sessions(stream, "t", ["k"], "2 minutes", "10 minutes")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/s").option("checkpointLocation", f"{tmp_path}/c2").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: sorted(r.n for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{name}").collect())
    # 4400 is not more than ten minutes before 5000, 60 is
    assert read("late") == [6] and read("on_time") == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    given = sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/s").collect())
    assert given == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 1)]


def test_polling_keeps_validators_and_polls_again(spark, tmp_path):
    def polite(url, headers, timeout, most):
        """A server that has one version of a document, and for ``/broken`` none."""
        if url.endswith("/broken"):
            raise OSError("no answer")
        if headers.get("If-None-Match") == '"v1"':
            return Response(304, {})
        return Response(200, {"ETag": '"v1"', "Last-Modified": "Mon, 01 Jan 2024 00:00:00 GMT"}, b"<rss/>")

    use_rocksdb(spark)
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    add = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(source)
    run = lambda every, sink, **trigger: poll(spark.readStream.schema("url string").parquet(source), transport=polite, every=every).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-c").trigger(**trigger).start()
    status = lambda sink=sink: [(r.url[-1], r.status) for r in spark.read.schema("url string, polled timestamp, status int").parquet(sink).orderBy("polled", "url").collect()]
    add("http://example.com/a", "http://example.com/a", "http://example.com/broken")
    run(0, sink, availableNow=True).awaitTermination()
    assert sorted(status(), key=str) == [("a", 200), ("n", None)]
    add("http://example.com/a", "http://example.com/b")
    run(0, sink, availableNow=True).awaitTermination()
    assert sorted(status(), key=str) == sorted([("a", 200), ("n", None), ("a", 304), ("b", 200)], key=str)
    last = spark.read.parquet(sink).where("status = 304").first()
    assert (last.etag, last.body) == ('"v1"', None)
    # a timer polls without a new row
    query = run(1, sink + "2", processingTime="1 second")
    again, until = lambda: sum(s == 304 for u, s in status(sink + "2") if u == "b"), time.monotonic() + 60
    try:
        while not os.path.exists(sink + "2/_spark_metadata/0") or again() < 2 and time.monotonic() < until:
            assert time.monotonic() < until and query.exception() is None
            time.sleep(1)
    finally:
        query.stop()
    assert again() >= 2


def test_merged_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 5).alias("feed"), (F.col("id") % 3).alias("day"), (F.col("id") * 7919 % 20_011).alias("v"))
    kept = stored(rows, "v", ["feed", "day"], 12)
    assert kept.count() == 15
    exact = {(r.feed, r.day): r.d for r in rows.cube("feed", "day").agg(F.countDistinct("v").alias("d")).collect()}
    for size, most in ((16, 0.0), (12, 0.06)):
        got = cubed(stored(rows, "v", ["feed", "day"], size), ["feed", "day"], size).collect()
        assert len(got) == 24 and all(abs(r.distinct - exact[r.feed, r.day]) <= most * exact[r.feed, r.day] for r in got)
        assert sum(r.seen for r in got if r.feed_all and r.day_all) == 60_000
