import random
import re

from feedweave.llm.quality import accepted, quality, repeated_words
from pyspark.sql import functions as F

from feedweave.llm.common import words

DOCS = "doc_id long, text string, bad string, n_words int"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(1)
    vocab = ["the", "of", "é", "word,", "x#", "|", "a&b", "\U0001f600"]
    out = [None, "", " \n\t ", "a b c a b c a b c", "a a a a", "one two", "x y z\nx y z\n\nx y z"]
    return out + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(1, 120))) for _ in range(60)]


def test_statistics_equal_brute_force(spark):
    data = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], DOCS)
    got = {r.doc_id: r for r in quality(docs, spark.createDataFrame([], LABELS)).collect()}
    for i, t in data:
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed) and r.rule is None


def test_long_text_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30_000)) + " w5 w6 w7"
    assert spark.createDataFrame([(text,)], "t string").select(repeated_words(words(F.col("t"))).alias("n")).first().n == 6


def corpus(rng):
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200)))
    rows, labels = [], []
    for i in range(400):
        t = good()
        if i % 5 == 0:
            t = t.replace(" ", "*** ") if i % 2 else t.upper().replace(" ", "!! ")
        rows.append((i, t, "", 0))
        if i < 300:
            labels.append((i, int(i % 5 != 0), 0))
    return rows, labels + [(7, None, 0), (None, 0, 0), (11, 0, 0)]


def test_rules_are_learned_and_applied(spark):
    rows, labels = corpus(random.Random(2))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality(docs, marks).collect()}
    assert [i for i in got if got[i].kept == (i % 5 == 0)] == []
    assert all(got[i].rule for i in range(0, 400, 5))
    kept = accepted(docs, marks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 5]


def test_no_rows_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0), (1, "a b", "", 0), (None, None, "", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert quality(docs, none).count() == 3
    assert quality(docs.limit(0), none).count() == 0
    assert sorted((r.doc_id or 0) for r in accepted(docs, none).collect()) == [1, 1]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    plan = quality(docs, spark.createDataFrame([], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
