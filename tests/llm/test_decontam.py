import random

import numpy as np
import pytest

from feedweave.llm.decontam import common_length, contaminated, decontaminate, grams, latent_space, rare_grams, term_weights, word_hashes

DOCS = "doc_id long, text string, item_id string, share int"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert common_length(a, b) == brute_lcs(a, b)


def test_word_hashes_depend_on_the_word_alone():
    h, edges = word_hashes([b"One two,THREE", b"", b"  three one \xc3\xa9! two"])
    assert edges.tolist() == [0, 3, 3, 7]
    assert h[0] == h[4] and h[1] == h[6] and h[2] == h[3] and len(set(h.tolist())) == 4


def corpus():
    rng = random.Random(5)
    common = ["the", "of", "and", "to", "in"]
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab)
    say = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(15, 60))) + ".") for k in range(40)]
    docs, truth = [], set()
    for i in range(300):
        body = say(rng.randrange(30, 400))
        if i % 10 == 0:
            k = rng.randrange(40)
            own = items[k][1].split()
            if i % 20 == 0:
                own = [w.upper() + "," if rng.random() < 0.2 else w for w in own]
            else:
                cut = len(own) - max(3, len(own) // 5)
                own = [w for w in own[:cut] if rng.random() > 0.2] + own[cut:]
            at = rng.randrange(len(body))
            body[at:at] = own
            truth.add((i, k))
        docs.append((i, " ".join(body), "", 0))
    return docs, items, truth


def test_planted_copies_and_paraphrases_are_found_and_nothing_else(spark):
    docs, items, truth = corpus()
    table = spark.createDataFrame(docs, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r[1]) for r in contaminated(table, bench, keep=["doc_id"]).collect()}
    assert len(truth - got) <= 1 and got <= truth
    left = decontaminate(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {i for i, _ in got}


@pytest.mark.parametrize("n", [40, 2000])
def test_recall_does_not_fall_with_the_number_of_items(spark, n):
    """Truth by construction: every planted item meets the rule of copies, or of paraphrases."""
    rng = random.Random(n)
    common = ["the", "of", "and", "to", "in", "that", "it"]
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(4000)]
    say = lambda k: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(k)]
    items = [(k, " ".join(say(rng.randrange(15, 61)))) for k in range(n)]
    docs, planted = [], {}
    for i in range(500):
        body, k = say(rng.randrange(30, 300)), rng.randrange(n)
        words = items[k][1].split()
        kept, paraphrase = list(words), i % 2 == 1
        if paraphrase:
            cut = len(words) - max(3, len(words) // 5)
            go = set(rng.sample(range(cut), int(0.3 * len(words))))
            kept = [w for j, w in enumerate(words) if j not in go]
        at = rng.randrange(len(body))
        body[at:at] = kept
        docs.append((i, " ".join(body), "", 0))
        planted[i] = k, paraphrase, len(words) < 25
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r[1]) for r in contaminated(spark.createDataFrame(docs, DOCS).repartition(4), bench, keep=["doc_id"]).collect()}
    for paraphrase, short, least in ((False, False, 0.98), (False, True, 0.98), (True, False, 0.95), (True, True, 0.95)):
        some = [(i, k) for i, (k, p, s) in planted.items() if (p, s) == (paraphrase, short)]
        assert len(some) > 30 and sum(x in found for x in some) >= least * len(some), (paraphrase, short, sum(x in found for x in some), len(some))


def test_rare_runs_of_words(spark):
    h, edges = word_hashes([b"a b c d", b"b c", b"x b c d a b c"])
    g = grams(h.view(np.int64))
    assert g[0] == g[10] and g[1] == g[7] and len(set(g.tolist())) == 9
    weights = np.zeros(1 << 17)
    assert len(rare_grams(h[:4].view(np.int64), weights, 10**6)) == 0
    assert len(rare_grams(h[:4].view(np.int64), weights + 3, 10**6)) == 2 and len(rare_grams(h[:2].view(np.int64), weights + 9, 10)) == 0


def test_singular_vectors_equal_numpy(spark):
    rng = np.random.default_rng(0)
    words = rng.integers(-(2**62), 2**62, 60)
    rows = [(k, [int(x) for x in rng.choice(words, 30)], True) for k in range(50)]
    passages = spark.createDataFrame(rows, "item_id long, words array<long>, ends boolean").repartition(3)
    weights = rng.random(1 << 17) + 0.5
    terms, space = latent_space(passages, weights, rank=20, rounds=6)
    place = {int(t): k for k, t in enumerate(terms)}
    dense = np.zeros((50, len(terms)))
    for k, w, _ in rows:
        for x in w:
            t = int(np.uint64(np.int64(x).view(np.uint64)) >> np.uint64(47))
            dense[k, place[t]] += weights[t]
    values = np.linalg.svd(dense, compute_uv=False)
    got = np.linalg.norm(dense @ space, axis=0)
    assert np.allclose(got[:10], values[:10], rtol=0.02)


def test_weights_count_blocks(spark):
    docs = spark.createDataFrame([(1, "a " * 16 + "b", "", 0), (2, None, "", 0)], DOCS)
    h, _ = word_hashes([b"a", b"b", b"c"])
    w = term_weights(docs)[0][(h >> np.uint64(47)).astype(int)]
    assert np.allclose(w, np.log(3 / np.array([2, 2, 1])))


def test_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, "", 0), (None, "", "", 0), (2, "long " * 5000, "", 0)], DOCS)
    items = spark.createDataFrame([(1, None), (None, "a b c d e f g"), (3, "..."), (4, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    assert contaminated(docs, items).count() == 0 and decontaminate(docs, items).count() == 3
    assert contaminated(docs, items.limit(0)).count() == 0 and decontaminate(docs, items.limit(0)).count() == 3
    assert contaminated(docs.limit(0), items).count() == 0
