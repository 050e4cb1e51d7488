import hashlib

import numpy as np
import pytest

from feedweave.llm import suffix
from feedweave.llm.suffix import previous_factors, remove_repeats, suffix_order


def brute(rows, least, keep_first):
    """Kept bytes by comparing all windows; rows are (id, text)."""
    at = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            at.setdefault(b[k : k + least], []).append((i, k))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            found = at[b[k : k + least]]
            if len(found) > 1 and not (keep_first and found[0] == (i, k)):
                gone[k : k + least] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared, other = word(500), word(230)
    out = [word(int(n)) for n in rng.integers(0, 900, 60)]
    out += [word(50) + shared + word(40), shared[100:350] + word(300), word(10) + shared[:260], other + "x" + other, "Orre " * 300, out[3], out[4], out[5] + "!", word(100) + other[5:], None, "", "Orre " * 200]
    return list(enumerate(out))


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, keep_first, hot):
    if hot:
        monkeypatch.setattr(suffix, "HOT", 10**9)
        monkeypatch.setattr(suffix, "LEAST_HOT", 0)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, keep_first=keep_first).collect()}
    want = brute(rows, 200, keep_first)
    assert {i for i in want if want[i] != got[i]} == set()


@pytest.mark.parametrize("most", [1, 3, 8, 40])
def test_previous_factors_equal_brute_force(most):
    rng = np.random.default_rng(most)
    for n in (1, 2, 3, 17, 64, 150):
        data = rng.integers(97, 99, n + most - 1).astype(np.uint8)
        text = data.tobytes()

        def common(i, j):
            return next((k for k in range(most) if text[i + k] != text[j + k]), most)

        order, lcp = suffix_order(data, np.arange(n), most)
        assert [text[i : i + most] for i in order] == sorted(text[i : i + most] for i in range(n))
        assert lcp.tolist() == [0, *(common(i, j) for i, j in zip(order, order[1:]))]
        length, match = previous_factors(order, lcp)
        for i, found, at in zip(order, length, match):
            assert found == max((common(i, j) for j in range(i)), default=0)
            assert (at == -1) if not found else (order[at] < i and common(i, order[at]) == found)


def test_very_long_text(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghij "), 2_000_000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 50 + long[1_000_000:1_200_000]), (3, long[:199])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(docs, keep_first=True).collect()}
    assert got == {1: (0, 0), 2: (200_000, 1), 3: (0, 0)}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(docs, keep_first=False).collect()}
    assert got == {1: (200_000, 1), 2: (200_000, 1), 3: (0, 0)}


def test_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 10 + "b" * 300), (1, "a" * 10 + "b" * 300), (None, "q" * 99)], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeats(docs, keep_first=False).collect()) == [0, 310, 310]
    assert remove_repeats(docs.limit(0)).count() == 0
