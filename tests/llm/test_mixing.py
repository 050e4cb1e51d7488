import hashlib
import math
from collections import Counter, defaultdict

import pytest

from feedweave.llm.mixing import exponent, mix, plan, realise

SCHEMA = "doc_id long, text string, source string, block string, _cut int"


def rows():
    out = []
    for i in range(900):
        s = "hot" if i % 3 else f"s{i % 4}"
        out.append((i, "w " * (i % 17), s, "x", 0))
    return out + [(900, None, None, "x", 0), (901, "a b c", None, "x", 0)]


def brute(data, evenness, repeats, seed=11):
    tokens = defaultdict(int)
    for _, t, s, *_ in data:
        tokens[s] += len((t or "").split()) + 1
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def weights(a):
        z = sum(p**a for p in shares.values())
        return {s: p**a / z for s, p in shares.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def most(a):
        return max(w * total / tokens[s] for s, w in weights(a).items())

    def bisect(good):
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return round(low, 6)

    goal = evenness * math.log(len(shares))
    a = 1.0 if entropy(1) >= goal else bisect(lambda x: entropy(x) >= goal)
    if most(a) > repeats:
        a = 1.0 if most(1) > repeats else bisect(lambda x: most(x) > repeats)
    out = Counter()
    for s, w in weights(a).items():
        budget = math.floor(w * total)
        full, rest = divmod(budget, tokens[s])
        own = [(i, len((t or "").split()) + 1) for i, t, x, *_ in data if x == s]
        for i, _ in own:
            for b in range(full):
                out[i, b] += 1
        key = lambda i: int(hashlib.md5(f"{seed}:{full}:{i}".encode()).hexdigest()[:15], 16)
        seen = 0
        for i, n in sorted(own, key=lambda x: key(x[0])):
            if seen < rest:
                out[i, full] += 1
            seen += n
    return a, out


@pytest.mark.parametrize("evenness,repeats", [(0.0, 99), (0.9, 99), (0.97, 1.5), (1.0, 2)])
def test_blocks_equal_brute_force(spark, evenness, repeats):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    _, want = brute(data, evenness, repeats)
    found, sources = plan(docs, evenness=evenness, repeats=repeats)
    got = Counter((r.doc_id, r.block) for r in realise(found, sources).collect())
    assert got == want
    assert abs(sum(r.weight for r in sources.collect()) - 1) < 1e-9


def test_exponent(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    assert exponent(shares, 0.0, 99) == 1.0
    assert exponent(shares, 1.0, 99) == 0.0
    assert 0 < exponent(shares, 0.95, 99) < 1


def test_mix_keeps_columns_and_takes_rows_as_often_as_planned(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    got = mix(docs, evenness=0.97)
    _, want = brute(data, 0.97, 4.0)
    assert got.columns == docs.columns
    per = Counter()
    for (i, _), n in want.items():
        per[i] += n
    assert Counter(r.doc_id for r in got.collect()) == per


def test_nothing_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a", "s", "", 0), (1, "a", "s", "", 0)], SCHEMA)
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs).count() == 2
