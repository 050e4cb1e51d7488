"""The pipeline on a small fixture, where it is known what each stage must do."""

import random
from collections import Counter

import corpus_pipeline
from feedweave.llm.mixing import mix
from feedweave.llm.queries import ORACLE_SQL, QUERIES


def fixture():
    rng = random.Random(6)
    common = ["the", "of", "and", "to"]
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(2000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(40))) for k in range(12)]
    docs, labels, junk, copies, leaks = [], [], set(), set(), set()
    for i in range(260):
        words, kind = say(rng.randrange(80, 200)), i % 13
        if kind == 1:
            words, junk = [w + "***" for w in words], junk | {i}
        elif kind == 2:
            words, copies = docs[i - 2][1].split(), copies | {i}
        elif kind == 3:
            words, leaks = words[:20] + items[i % 12][1].split() + words[20:], leaks | {i}
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, int(kind != 1), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    return docs, labels, items, junk, copies, leaks


def test_stages_and_run(spark, tmp_path):
    docs, labels, items, junk, copies, leaks = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {d[0] for d in docs}
    gone = [junk | {900, 901}, copies, leaks]
    for (_, stage), less in zip(corpus_pipeline.STAGES[:3], gone):
        out = stage(spark, now, str(tmp_path))
        want -= less
        assert out.columns == now.columns and {r.doc_id for r in out.collect()} == want
        now = out
    mixed = Counter(r.doc_id for r in mix(now).collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == mixed
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
