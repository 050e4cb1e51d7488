import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedweave.llm import phrases
from feedweave.llm.phrases import collocations, leading, radix_order, runs, words_of

SCHEMA = "doc_id long, text string, lang string, ids string, n int, word int"


def brute(docs, least=30, most=2000, percent=80):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in f.items():
        c = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        dropped = {q[i : i + k] for q, b in c.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= percent * c[q[i : i + k]]}
        scored = []
        for p, a in c.items():
            if p not in dropped:
                score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "the", "of", "Éa", "日本", "x\x00y", "a\x1fb", "in", "spite"] + [f"w{i}" for i in range(40)]
    fixed = ["new york city hall", "in spite of the", "out of the blue sky, and", "in  spite\tof"]
    out = []
    for _ in range(n):
        parts = [str(rng.choice(fixed)) if rng.random() < 0.4 else " ".join(rng.choice(words, rng.integers(1, 9), p=None)) for _ in range(rng.integers(1, 12))]
        out.append("".join(p + str(rng.choice([" ", ". ", "\n", "\r\n", ";", " "])) for p in parts))
    return out


def found(spark, docs, **more):
    rows = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in collocations(rows, **more).collect())


def test_phrases_are_those_of_brute_force(spark):
    docs = [(t, ["en", "en", "en", "de", None, "und"][i % 6]) for i, t in enumerate(texts(900))]
    docs += [(None, "en"), ("", "fr"), ("one two three " * 20_000, "en"), ("y" * 200_000, "de")] + [("b a\n", "zz")] * 40
    want = brute(docs)
    assert found(spark, docs) == want and len(want) > 20 and {w[0] for w in want} == {"en", "de", "und", "zz"}
    assert found(spark, docs, least=50, most=7, percent=60) == brute(docs, 50, 7, 60)


def test_small_batches_change_nothing(spark):
    docs = [(t, "en") for t in texts(200, 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, docs, least=10) == brute(docs, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ids_that_clash_are_made_anew(spark):
    first = phrases.language_seed("en", 42)
    encode = lambda word, seed: len(word) if seed == first else phrases.word_id(word, seed)
    docs = spark.createDataFrame([(1, "a b " * 40 + "rare1 cc", "en")], "doc_id long, text string, lang string")
    words, totals, seed = phrases.dictionary(docs, 30, encode=encode)
    assert seed == 43 and {bytes(r["word"]): r["n"] for r in words.collect()} == {b"a": 40, b"b": 40}
    assert [tuple(r) for r in totals.collect()] == [("en", 82)]
    # rare words may share an id, as no phrase holds them
    docs = spark.createDataFrame([(1, "a " * 40 + "b2 cc", "en")], "doc_id long, text string, lang string")
    assert phrases.dictionary(docs, 30, encode=encode)[2] == 42


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_radix_order_and_runs(size):
    rng = np.random.default_rng(size)
    columns = [rng.integers(0, 1 << 63, 5000).astype(np.uint64) if k else rng.integers(0, 40, 5000).astype(np.uint64) << np.uint64(57) for k in range(size)]
    columns = [np.r_[c, c[:2000]] for c in columns]
    order = radix_order(columns[0])
    assert sorted(order.tolist()) == list(range(7000)) and (np.diff((columns[0] >> np.uint64(32))[order].astype(np.int64)) >= 0).all()
    rows = list(zip(*(c.tolist() for c in columns)))
    for given in (None, np.arange(7000)):
        keys, n = runs(columns, given)
        summed = Counter()
        for key, k in zip(zip(*(c.tolist() for c in keys)), n.tolist()):
            summed[key] += k
        want = Counter()
        for i, r in enumerate(rows):
            want[r] += 1 if given is None else i
        assert summed == want
    assert (leading(columns) - leading([np.zeros(7000, np.uint64), *columns[1:]]) == columns[0]).all()


def test_words_and_empty_tables(spark):
    assert words_of("A b\tC.d;\x0be f\r\n É".encode()) == [b"a", b"b", b"c", b".", b"d", b".", b".", b"e", b"f", b".", b".", "É".encode()]
    assert found(spark, []) == []


def test_encoded_text_is_in_short_rows_that_lose_no_phrase(spark):
    words = [f"w{i * i % 97 + i // 5000}" for i in range(30_000)]
    docs = spark.createDataFrame([(" ".join(words), "en")], "text string, lang string")
    found, known, _ = phrases.counted(docs, 30)
    spell = {r.id: r.word.decode() for r in known.collect()}
    got = {tuple(spell[i] for i in r.ids): r.n for r in found.collect()}
    want = Counter(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert got == {w: n for w, n in want.items() if n >= 30} and len(got) > 300
    blocks = phrases.encoded(docs, phrases.Filter(known, "id"), 42)
    assert blocks.agg(F.max(F.octet_length("ids"))).first()[0] <= 1 << 17
