import numpy as np
from pyspark.sql import functions as F

from feedweave.llm.langid import grams, identify, train
from feedweave.llm.lm import CLASSES, SINGLES, Model, Trainer, bucket, normalisers, score, tokens

DOCS = "doc_id long, text string, lang string, score string"


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


LANGS = {"aa": ["ba", "lo", "mi", "té"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["tion", "ing", "th", "er"]}


def rows(n=240):
    rng = np.random.default_rng(7)
    out = []
    for i in range(n):
        lang = list(LANGS)[i % 3]
        out.append((i, speech(rng, LANGS[lang], int(rng.integers(3, 60))), lang, ""))
    return out


def test_language_on_held_out_rows(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = identify(docs.where("doc_id >= 120"), train(docs.where("doc_id < 120")), keep=["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_equals_brute_force(spark):
    data = rows(60)
    docs = spark.createDataFrame(data, DOCS)
    counts = {}
    for _, t, lang, _ in data:
        counts.setdefault(lang, np.zeros(1 << 15))
        np.add.at(counts[lang], grams(t), 1)
    logs = {k: np.log((c + 0.5) / (c + 0.5).sum()) for k, c in counts.items()}
    want = {i: max(sorted(logs), key=lambda k: logs[k][grams(t)].sum()) for i, t, *_ in data}
    assert {r.doc_id: r.lang_pred for r in identify(docs, train(docs), keep=["doc_id"]).collect()} == want


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "aa", ""), (2, "", "aa", ""), (3, "12 !?", None, ""), (4, "é" * 100_000, None, ""), (None, "abc", "aa", ""), (None, "abc", "aa", "")], DOCS)
    got = [(r.doc_id, r.lang_pred) for r in identify(docs, train(docs), keep=["doc_id"]).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (None, "aa"), (None, "aa")]
    none = train(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.limit(0), none).count() == 0


def base_of(text, counts):
    n, v = sum(counts.values()), len(counts)
    return sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text))


def test_scores_and_base(spark, monkeypatch):
    from collections import Counter

    from feedweave.llm import lm

    monkeypatch.setattr(lm, "HEAD", 40)  # most words are looked up by a join
    data = rows(300) + [(900, None, "", ""), (901, "", "", ""), (902, "unseen words é", "", "")]
    docs = spark.createDataFrame(data, DOCS).withColumn("held_out", F.col("doc_id") % 5 == 1)
    counts = Counter()
    for i, t, *_ in data:
        if i % 5 != 1:
            counts.update(tokens((t or "").encode()))
    got = {r.doc_id: r for r in score(docs, docs.where("not held_out"), keep=["doc_id", "held_out"]).collect()}
    for i, t, *_ in data:
        words = tokens((t or "").encode())
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in counts for w in words), sum(counts.values()))
        assert abs(got[i].base_score - base_of((t or "").encode(), counts)) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_rows_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (None, None, "", "")], DOCS)
    got = score(docs, docs.limit(0), keep=["doc_id"]).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3] and all(r.n_known == 0 and np.isfinite(r.score) for r in got)
    assert score(docs.limit(0), docs, keep=["doc_id"]).count() == 0


def test_probabilities_add_up_to_one(spark):
    n = SINGLES + 1 + CLASSES
    rng = np.random.default_rng(1)
    noise = np.full(n, 1 / n)
    model = Model.start(noise)
    trainer = Trainer(model, noise, 1)
    for _ in range(5):
        c2, c1, w = rng.integers(0, n, (3, 4096))
        trainer.step(c2, c1, w)
    z = normalisers(spark, model)
    for c2, c1 in ((0, 0), (5, 900), (1000, 3)):
        logs = (model.near[c1] + model.far[c2]) @ model.out.T + model.bias - z[c2, c1]
        assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3
    assert SINGLES < bucket(b"word") < n
