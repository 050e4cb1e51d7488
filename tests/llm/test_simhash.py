import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from feedweave.llm.simhash import Forest, Trie, majority, near_dedup, shingle_hashes, simhash, simhash_dedup, trie_join

SCHEMA = "doc_id long, text string, fp string, root int"


def brute(text, width=4):
    words = (text or "").lower().split() if (text or "").isascii() else (text or "").split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps, most=4):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 400))) for _ in range(60)]
    near = [t + " tail" for t in texts[:20]] + [t.replace("w1 ", "x ", 1) for t in texts[20:40]]
    return [*enumerate([*texts, *near, *texts[:10], None, "", " \n\t", "One two", "one TWO", "a b c d", "word " * 30_000])]


def test_majority_of_many_hashes():
    hashes = np.random.default_rng(0).integers(0, 2**64, 1001, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > 1001)
    assert majority(hashes) == want
    assert majority(np.array([], np.uint64)) == 0


def test_shingles_of_short_texts():
    assert list(shingle_hashes(b"", 4)) == []
    assert list(shingle_hashes(b"A  b", 4)) == [xxhash.xxh64_intdigest(b"a b", 42)]


@pytest.mark.parametrize("lead", [2, 1])
def test_trie_join_finds_what_comparing_all_pairs_finds(lead):
    rng = np.random.default_rng(lead)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    dense = np.uint64(0xABCDEF0123456789) ^ np.arange(700, dtype=np.uint64)
    values = np.unique(np.concatenate([base, near, dense]))
    for a, b in ((values, values), (values[::2].copy(), values[1::2].copy())):
        same = a is b
        x = a[:, None] ^ b[None, :]
        close = (np.bitwise_count(x) <= 4) & (np.bitwise_count(x >> np.uint64(32)) <= lead)
        left = Trie(a)
        got, want = Forest(len(a) + len(b)), Forest(len(a) + len(b))
        shift = 0 if same else len(a)
        for u, v in trie_join(left, left if same else Trie(b), lead, 4):
            assert (np.bitwise_count(a[u] ^ b[v]) <= 4).all()
            got.link(u, v + shift)
        u, v = np.nonzero(close)
        want.link(u, v + shift)
        assert (got.root == want.root).all()


def test_simhash_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA)
    got = {r.doc_id: r for r in simhash(docs).collect()}
    fps = [brute(t) for _, t in data]
    assert [got[i].fp & (2**64 - 1) for i, _ in data] == fps
    assert [got[i].component_id for i, _ in data] == classes([i for i, _ in data], fps)


def test_simhash_of_nulls_ties_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b", "", 0), (5, "a b", "", 0), (5, "a b", "", 0), (None, None, "", 0)], SCHEMA)
    got = simhash(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert simhash(docs.limit(0)).count() == 0


def test_near_dedup_of_similar_texts(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(4000)]
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, near, clean = [], [], []
    for i in range(150):
        words = list(rng.choice(vocab, 400))
        rows.append((i, " ".join(words), "", 0))
        other = list(words)
        for k in rng.choice(400, 5 if i % 2 else 60, replace=False):
            other[k] = "x" + other[k]
        share = len(sets(words) & sets(other)) / len(sets(words) | sets(other))
        rows.append((1000 + i, " ".join(other), "", 0))
        (near if share >= 0.85 else clean if share < 0.7 else []).append(1000 + i)
    kept = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(range(150)) <= kept and set(clean) <= kept
    assert len(near) > 60 and len(kept & set(near)) <= 2


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "x y z a b c", "", 0), (1, "x y z a b c", "", 0), (7, "other words are here now yes", "", 0), (7, "other words are here now yes", "", 0), (None, "n", "", 0)], SCHEMA)
    got = near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 1, 7]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def stays(texts):
    """By rising id, the texts that are not 0.8 like one that stays; all pairs compared."""
    kept = {}
    for i in sorted(texts):
        s = shingles(texts[i])
        if all(len(s & o) < 0.8 * len(s | o) for o in kept.values()):
            kept[i] = s
    return set(kept)


def test_near_dedup_decides_pairs_beside_the_threshold(spark):
    rng = np.random.default_rng(21)
    vocab = [f"w{i}" for i in range(5000)]
    texts, shares = {}, []
    for i in range(150):
        words = list(rng.choice(vocab, rng.integers(100, 900)))
        other = list(words)
        for k in rng.choice(len(words), max(1, round(len(words) * rng.uniform(0.018, 0.034))), replace=False):
            other[k] = "x" + other[k]
        a, b = shingles(words), shingles(other)
        shares.append(len(a & b) / len(a | b))
        texts |= {i: words, 1000 + i: other}
    assert sum(0.75 <= x < 0.8 for x in shares) > 20 and sum(0.8 <= x <= 0.85 for x in shares) > 20
    docs = spark.createDataFrame([(i, " ".join(w), "", 0) for i, w in texts.items()], SCHEMA).repartition(3)
    assert {r.doc_id for r in near_dedup(docs).collect()} == stays(texts)


def test_near_dedup_of_many_groups_on_one_template(spark):
    rng = np.random.default_rng(22)
    vocab = [f"w{i}" for i in range(5000)]
    form, texts = list(rng.choice(vocab, 300)), {}
    for g in range(24):
        own = form + list(rng.choice(vocab, 60))
        for k in range(6):
            words = list(own)
            words[int(rng.integers(0, 300))] = f"x{g}_{k}"
            texts[int(rng.integers(0, 10**9))] = words
    want = stays(texts)
    docs = spark.createDataFrame([(i, " ".join(w), "", 0) for i, w in texts.items()], SCHEMA).repartition(3)
    assert 5 < len(want) < len(texts) / 2 and {r.doc_id for r in near_dedup(docs).collect()} == want


def joined_rows(spark, work):
    """The most rows that a join made in all that ``work`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    run = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    known, most = set(run()), 0
    work()
    for k in set(run()) - known:
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_near_dedup_meets_a_pair_once_however_many_hashes_it_shares(spark):
    rng = np.random.default_rng(23)
    vocab = [f"w{i}" for i in range(5000)]
    form, texts = list(rng.choice(vocab, 300)), {}
    for k in range(30):
        words = list(form)
        for at in rng.choice(300, 4, replace=False):
            words[int(at)] = f"x{k}_{at}"
        texts[k] = words
    docs, got = spark.createDataFrame([(i, " ".join(w), "", 0) for i, w in texts.items()], SCHEMA).repartition(3).localCheckpoint(), []
    most = joined_rows(spark, lambda: got.extend(r.doc_id for r in near_dedup(docs).collect()))
    assert set(got) == stays(texts)
    assert 0 < most <= 30 * 75  # texts by the hashes of a prefix


def test_near_dedup_judges_rows_of_one_id_apart(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "other words are here now"), (3, "p q r s t u"), (3, "v w x y z a"), (3, "v w x y z a")]
    got = near_dedup(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, rows[0][1]), (2, rows[2][1]), (3, rows[3][1]), (3, rows[4][1])]


def test_pipeline_drops_what_simhash_links(spark):
    """Repeats change no set of shingles and no exact text; only the fingerprint tells that two texts are near."""
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    loop, tail = own(7), [own(9), own(9)]
    near = [f"{' '.join([loop] * 60)} {t}" for t in tail]  # an odd number of shingles, repeated, decides every bit
    rows = [(1, own(80)), (2, near[0]), (3, near[1]), (3, own(80)), (None, near[1]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert kept(simhash_dedup(docs)) == sorted([r for r in rows if r != rows[2]], key=str)
    assert kept(near_dedup(docs)) == sorted(rows, key=str)
    assert kept(corpus_pipeline.simhash_near_dedup(spark, docs, "")) == sorted([r for r in rows if r != rows[2]], key=str)
