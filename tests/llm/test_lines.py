import random

import pytest
import xxhash
from pyspark.sql import functions as F

from feedweave.llm.lines import edit_distance, line_duplicates, remove_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.34:
            s.insert(k, rng.choice("abcé "))
        elif s and what < 0.67:
            del s[min(k, len(s) - 1)]
        elif s:
            s[min(k, len(s) - 1)] = rng.choice("abcé ")
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_distance(spark, most):
    rng = random.Random(most)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 40, 90])))
        pairs.append((a, edited(rng, a, rng.randrange(6))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    for r in got:
        d = distance(r.a, r.b)
        assert (r.d == d) if d <= most else (r.d > most), tuple(r)


def rank(line):
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, edits, least):
    first, order = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for no, x in enumerate((t or "").split("\n")):
            if x.split(" ") != [""] * len(x.split(" ")):
                first.setdefault(x, (i, no))
    near = {x for x in first for y in first if x != y and min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and rank(y) < rank(x) and distance(x, y) <= edits}
    return {i: [no for no, x in enumerate((t or "").split("\n")) if x in first and (x in near or first[x] != (i, no))] for i, t in rows}


def test_dropped_lines_equal_brute_force(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n)) + "x"
    base = [line(rng.randrange(30, 80)) for _ in range(40)]
    pool = base + [edited(rng, rng.choice(base), rng.randrange(1, 5)) for _ in range(120)] + ["short", "shorn", "", "   "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 8)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, dropped string, h int").repartition(3)
    want = brute(rows, 2, 40)
    got = line_duplicates(docs).collect()
    assert {r.doc_id: list(r.dropped) for r in got} == want
    assert all(r.n_exact + r.n_near == len(r.dropped) for r in got)
    kept = {r.doc_id: r.text for r in remove_lines(docs).collect()}
    assert all(kept[i] == (t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])) for i, t in rows)


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b\na b"), (2, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_lines, list(r.dropped)) for r in line_duplicates(docs).collect())
    assert got == [(0, 2, [1]), (2, 1, [0]), (2, 1, [0]), (3, 0, [])]
    assert line_duplicates(docs.limit(0)).count() == 0


def test_no_link_is_left_out(spark, monkeypatch):
    monkeypatch.setattr("feedweave.llm.lines.MEMBERS", 16)  # so that keys are dealt out
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefé ") for _ in range(60)) + "x" for _ in range(4)]
    pool = sorted({edited(rng, rng.choice(base), rng.randrange(0, 3)) for _ in range(150)})
    assert min(map(len, pool)) >= 40
    rows = [(i, "\n".join(rng.choices(pool, k=3))) for i in range(90)]
    there = sorted({x for _, t in rows for x in t.split("\n")})
    links = {x: sum(x != y and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in there) for x in there}
    got = line_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: sum(links[x] for x in t.split("\n")) for i, t in rows}
    assert sum(links.values()) > 500
