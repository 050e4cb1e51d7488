import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedweave.llm.resample import BUCKETS, counts, features, gains, ranked, resample, streams

SCHEMA = "doc_id long, text string, _id string, weight string, score int"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, num=5, den=100, least=20, seed=42):
    held = {d: buckets(t) for d, t in docs}
    s, t = Counter(), Counter()
    for _, b in held.values():
        s.update(b)
    for x in target:
        t.update(buckets(x)[1])
    ss, tt = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt))) for b in s}
    out = {}
    for d, (n, b) in held.items():
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in b)
        out[d] = [n, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d in out if out[d][0] >= least), key=lambda d: (-out[d][3], -1 if d is None else d))
    for k, d in enumerate(able[: num * len(able) // den], 1):
        out[d][4] = k
    return out


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "of", "Ärger", "naïve", "a1", "x-y", "é", "don't", "\x1f", "日本", "END."] + [f"w{i}" for i in range(200)]
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("share", [(5, 100), (1, 2), (1, 1)])
def test_weights_scores_and_ranks_are_those_of_brute_force(spark, share):
    docs = [(i, t) for i, t in enumerate(texts(400, 1))]
    docs += [(400, None), (401, ""), (402, "!!"), (403, "word " * 60_000), (404, docs[3][1]), (None, docs[5][1])]
    target = [*texts(20, 2), None, ""]
    rows = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], SCHEMA).repartition(7)
    got = resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), share).collect()
    assert {r["doc_id"]: [r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got} == brute(docs, target, *share) and len(got) == len(docs)


def test_repeated_rows_string_ids_and_empty_tables(spark):
    long = "one two three four five six seven eight nine ten " * 3
    target = spark.createDataFrame([("one two",)], "text string")
    got = resample(spark.createDataFrame([("a", long), ("a", long), ("b", "")], "doc_id string, text string"), target, (1, 1)).collect()
    assert sorted((r["doc_id"], r["rank"] or 0) for r in got) == [("a", 1), ("a", 2), ("b", 0)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, target).count() == 0
    assert resample(spark.createDataFrame([(1, long)], "doc_id long, text string"), none.select("text"), (1, 1)).first()["rank"] == 1


def test_streams_are_packed_with_offsets_and_counted(spark):
    docs = [(i, t) for i, t in enumerate(texts(300, 3))]
    blocks = streams(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = Counter(b for _, t in docs for b in buckets(t)[1])
    found = counts(blocks)
    assert {b: n for b, n in enumerate(found.tolist()) if n} == want
    for r in blocks.collect():
        stream, at = np.frombuffer(bytes(r["stream"]), "<u2"), 0
        for d, end in zip(r["ids"], r["ends"]):
            assert sorted(stream[at:end].tolist()) == sorted(buckets(docs[d][1])[1])
            at = end
        assert at == len(stream)


def test_features_carry_the_checksum_on():
    n, found = features("Ab cé, AB x".encode())
    assert (n, sorted(found.tolist())) == (4, sorted(buckets("ab cé ab x")[1]))
    assert len(features(b"")[1]) == 0
    assert gains(np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)).tolist() == [0] * BUCKETS


def test_ranks_follow_ties_over_partitions(spark):
    rows = spark.range(5000, numPartitions=6).selectExpr("id", "id % 3 as v")
    got = {r["id"]: r["rank"] for r in ranked(rows, ["v", "id"], 4000).collect()}
    order = sorted(range(5000), key=lambda i: (i % 3, i))
    assert got == {i: k + 1 if k < 4000 else None for k, i in enumerate(order)}
