import zlib
from collections import Counter

from feedweave.llm.sharding import interleave

SCHEMA = "doc_id long, source string, text string, shard string, _rank int"


def test_shards_are_even_and_each_holds_the_mixture(spark):
    data = [(i, "hot" if i % 3 else f"s{i % 5}", "é" * (i % 7), "x", 1) for i in range(5000)]
    got = interleave(spark.createDataFrame(data, SCHEMA), 24).collect()
    assert sorted(r.doc_id for r in got) == list(range(5000))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(n))
    total = Counter(r.source for r in got)
    for source, n in total.items():
        per = Counter(r["shard"] for r in got if r.source == source)
        assert max(per[s] for s in range(24)) - min(per[s] for s in range(24)) <= 2, source
    texts = {d[0]: d[2].encode() for d in data}
    assert all(r["_crc"] == zlib.crc32(texts[r.doc_id]) and r["_bytes"] == len(texts[r.doc_id]) for r in got)


def test_the_order_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", str(i), "", 0) for i in range(3000)], SCHEMA)
    a = {tuple(r) for r in interleave(docs.repartition(7)).collect()}
    assert a == {tuple(r) for r in interleave(docs.coalesce(1)).collect()}


def test_nulls_repeats_and_few_rows(spark):
    docs = spark.createDataFrame([(None, None, None, "", 0), (1, "a", "", "", 0), (1, "a", "", "", 0)], SCHEMA)
    got = interleave(docs, 24).collect()
    assert len(got) == 3 and sorted(r["shard"] for r in got) == [0, 1, 2] and {r.slot for r in got} == {0}
    assert interleave(docs.limit(0)).count() == 0
