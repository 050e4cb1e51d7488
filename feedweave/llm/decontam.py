"""Benchmark decontamination by latent semantic retrieval.

Windows of the texts that are near an item's in latent space are candidates. A space of
bounded rank holds the less of each item the more items there are, so runs of three words that
hardly occur by chance make candidates too, exactly, however many items and however short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import bounded, parts, powers, slices, table

#: Hashed terms; a passage is two blocks of BLOCK words; latent dimensions.
TERMS, BLOCK, RANK = 1 << 17, 16, 128
#: Longest stretch of a benchmark item that is looked for as one passage.
STRETCH = 192
#: Benchmark items that one pass over the documents looks for.
ITEMS = 20_000
#: Share of a passage's latent weight that a window must hold, and their cosine.
LEAST_SHARE, LEAST_COSINE = 0.45, 0.55
#: A run of GRAM words is rare if chance would put its words into under e**RARE of all blocks.
GRAM, RARE = 3, 5.0
#: Share of an item's words, in order, that make a copy; or, with the answer, a paraphrase.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin and end.

    Letters of either case are alike; ASCII marks separate words.
    """
    folded = [t.translate(_FOLD) for t in texts]
    data = np.frombuffer(b" " + b" ".join(folded) + b" ", np.uint8)
    inside = data != 32
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = turns[::2], turns[1::2]
    up, down = powers(len(data))
    sums = np.cumsum(data * up[: len(data)], dtype=np.uint64)
    h = (sums[last - 1] - sums[first - 1]) * down[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    edges = np.cumsum([1, *(len(t) + 1 for t in folded)])
    return h, np.searchsorted(first, edges)


def blocks(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms (-1 where a text's last block has no word), a row per block; blocks' edges by text."""
    n = np.diff(edges)
    per = -(-n // BLOCK)
    begin = np.r_[0, np.cumsum(per)]
    out = np.full(begin[-1] * BLOCK, -1, np.int32)
    text = np.repeat(np.arange(len(n)), n)
    out[begin[text] * BLOCK + np.arange(len(hashes)) - edges[text]] = (hashes >> np.uint64(64 - 17)).astype(np.int32)
    return out.reshape(-1, BLOCK), begin


def term_weights(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Inverse document frequency of each hashed term over all blocks of all texts, and the number of blocks."""

    def run(batches):
        counts, n = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches, "_text"):
            for _, texts in parts(batch):
                rows = np.sort(blocks(*word_hashes(texts))[0], axis=1)
                new = rows >= 0
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                counts += np.bincount(rows[new], minlength=TERMS)
                n += len(rows)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[counts[at], n])], names=["term", "n"])

    bounded(docs.sparkSession)
    found = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros(TERMS), 0
    for r in found:
        if r["term"] < 0:
            n = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return np.log((n + 1) / (counts + 1)), n


def item_passages(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """Stretches of the items: ``item_id``, word hashes, and whether the answer ends it."""

    def run(batches):
        for batch in slices(batches, "_text"):
            ids, hashes, last = [], [], []
            for first, texts in parts(batch):
                h, edges = word_hashes(texts)
                for i in range(len(texts)):
                    own = h[edges[i] : edges[i + 1]].view(np.int64)
                    for k in range(0, max(1, len(own) - STRETCH // 2), STRETCH // 2):
                        if len(own):
                            ids.append(batch.column("_id")[first + i].as_py())
                            hashes.append(own[k : k + STRETCH])
                            last.append(k + STRETCH >= len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(last, pa.bool_())], names=["item_id", "words", "ends"])

    return items.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, "item_id bigint, words array<bigint>, ends boolean")


def windows(words: np.ndarray) -> list[np.ndarray]:
    """Passages of two blocks' length, half of it apart, that cover the words."""
    size = 2 * BLOCK
    return [words[k : k + size] for k in range(0, max(1, len(words) - BLOCK), BLOCK)]


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - 17)).astype(np.int64)


def latent_space(passages: DataFrame, weights: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the passages' windows, and the leading right singular vectors.

    A randomised SVD of the TF-IDF matrix of all windows: tasks multiply their
    rows with a sketch and back, Spark adds up the products by term, and only
    term-by-rank sketches, bounded by TERMS, are made orthogonal on the driver.
    """
    sc = passages.sparkSession.sparkContext
    terms = np.array(sorted(r[0] for r in passages.select(F.explode("words").alias("w")).select(F.shiftrightunsigned("w", 64 - 17).cast("int")).distinct().collect()), np.int64)
    if not len(terms):
        return terms, np.zeros((0, rank), np.float32)
    rank = min(rank, len(terms))
    names = [f"v{k}" for k in range(rank)]
    shared_terms = sc.broadcast((terms, weights[terms]))

    def multiplied(sketch: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(sketch)

        def run(batches):
            known, idf = shared_terms.value
            out = np.zeros_like(shared.value)
            for batch in batches:
                for words in batch.column("words"):
                    for w in windows(np.array(words.as_py(), np.int64)):
                        at = np.searchsorted(known, terms_of(w))
                        scaled = idf[at][:, None]
                        row = (shared.value[at] * scaled).sum(0)
                        np.add.at(out, at, scaled * row)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *(pa.array(c) for c in out.T)], names=["term", *names])

        schema = ", ".join(["term int", *(f"{c} double" for c in names)])
        summed = passages.mapInArrow(run, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
        got = np.zeros((len(terms), rank))
        for r in summed.collect():
            got[r[0]] = r[1:]
        return got

    q = np.random.default_rng(seed).normal(size=(len(terms), rank))
    for _ in range(rounds):
        q = np.linalg.qr(multiplied(q))[0]
    product = multiplied(q)
    values, turn = np.linalg.eigh(q.T @ product)
    return terms, (q @ turn[:, ::-1]).astype(np.float32)


def common_length(words: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``words``."""
    masks: dict[int, int] = {}
    for k, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(words)) - 1
    v = full
    for w in text:
        u = v & masks.get(w, 0)
        v = (v + u | v - u) & full
    return len(words) - v.bit_count()


@dataclass(frozen=True)
class Index:
    """What a task needs to look for the passages of one pass."""

    items: list[int]
    words: list[list[int]]
    ends: list[bool]
    place: np.ndarray
    vectors: np.ndarray
    passage: np.ndarray
    queries: np.ndarray
    #: Rare runs of words, sorted, the passage of each, and which leading bits they have.
    grams: np.ndarray
    holder: np.ndarray
    leading: np.ndarray


#: Leading bits of a run's hash that are looked up before the run itself.
LEADING = 22


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    n, h = max(0, len(words) - GRAM + 1), np.uint64(0)
    for k in range(GRAM):
        h = (h + words[k : k + n].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def rare_grams(words: np.ndarray, weights: np.ndarray, blocks: int) -> np.ndarray:
    """The runs that hardly occur by chance, by the frequencies of their words."""
    w = weights[terms_of(words)]
    n = max(0, len(words) - GRAM + 1)
    together = sum(w[k : k + n] for k in range(GRAM))
    return np.unique(grams(words)[together >= np.log(blocks + 1) - RARE]) if n else np.zeros(0, np.uint64)


def index(passages: DataFrame, weights: np.ndarray, blocks: int) -> Index:
    terms, space = latent_space(passages, weights)
    rows = passages.orderBy("item_id", "words").collect()
    vectors = np.vstack([np.zeros((1, space.shape[1]), np.float32), space * weights[terms][:, None].astype(np.float32)]).astype(np.float32)
    place = np.zeros(TERMS, np.int32)
    place[terms] = np.arange(1, len(terms) + 1)
    passage, queries, runs = [], [], []
    for k, r in enumerate(rows):
        runs.append(rare_grams(np.array(r["words"], np.int64), weights, blocks))
        for w in windows(np.array(r["words"], np.int64)):
            passage.append(k)
            queries.append(vectors[place[terms_of(w)]].sum(0))
    held = np.concatenate([*runs, np.zeros(0, np.uint64)])
    order = np.argsort(held, kind="stable")
    leading = np.zeros(1 << LEADING, bool)
    leading[(held >> np.uint64(64 - LEADING)).astype(np.int64)] = True
    holder = np.repeat(np.arange(len(runs)), [len(x) for x in runs])[order]
    return Index([r["item_id"] for r in rows], [r["words"] for r in rows], [r["ends"] for r in rows], place, vectors, np.array(passage), np.array(queries, np.float32).reshape(len(passage), vectors.shape[1]), held[order], holder, leading)


def candidates(hashes: np.ndarray, edges: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, float]]:
    """(text, passage, block, cosine) wherever a window is near a passage's window."""
    terms, begin = blocks(hashes, edges)
    if not len(terms) or not len(ix.queries):
        return
    at = np.where(terms >= 0, ix.place[terms], 0)
    sums = np.zeros((len(terms), ix.vectors.shape[1]), np.float32)
    for k in range(0, len(terms), 2048):
        for column in at[k : k + 2048].T:
            sums[k : k + 2048] += np.take(ix.vectors, column, axis=0)
    last = np.zeros(len(terms), bool)
    last[begin[1:][np.diff(begin) > 0] - 1] = True
    pairs = sums.copy()
    pairs[:-1] += np.where(last[:-1, None], 0, sums[1:])
    own = np.sqrt((ix.queries * ix.queries).sum(1)) + 1e-9
    length = np.sqrt((pairs * pairs).sum(1)) + 1e-9
    for k in range(0, len(pairs), 8192):
        dots = pairs[k : k + 8192] @ ix.queries.T / own
        b, q = np.nonzero((dots >= LEAST_SHARE * own) & (dots >= LEAST_COSINE * length[k : k + 8192, None]))
        texts = np.searchsorted(begin, k + b, side="right") - 1
        yield from zip(texts.tolist(), ix.passage[q].tolist(), (k + b - begin[texts]).tolist(), (dots[b, q] / length[k + b]).tolist())


def sharing(hashes: np.ndarray, edges: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, float]]:
    """(text, passage, block, 0) wherever a text has a rare run of words of a passage."""
    g = grams(hashes.view(np.int64))
    if not len(g):
        return
    at = np.flatnonzero(ix.leading[(g >> np.uint64(64 - LEADING)).astype(np.int64)])
    text = np.searchsorted(edges, at, side="right") - 1
    inside = at + GRAM <= edges[text + 1]
    at, text = at[inside], text[inside]
    first, last = (np.searchsorted(ix.grams, g[at], side=side) for side in ("left", "right"))
    for k in np.flatnonzero(last > first):
        for p in ix.holder[first[k] : last[k]].tolist():
            yield int(text[k]), p, int(at[k] - edges[text[k]]) // BLOCK, 0.0


def verified(words: list[int], ends: bool, text: list[int]) -> tuple[float, bool]:
    """The largest share of a passage's words found in order in a span of 1.5 times
    its length, and whether the answer, its last fifth (3 words at least), is there too."""
    m = len(words)
    width, step = m + m // 2 + 1, max(1, m // 4)
    tail = words[-max(3, m // 5) :]
    best, answered = 0.0, False
    for k in range(0, max(1, len(text) - width + step), step):
        span = text[k : k + width]
        if sum(map(set(span).__contains__, words)) < max(PARAPHRASE, best) * m:
            continue
        share = common_length(words, span) / m
        if share > best:
            best = share
            answered = ends and common_length(tail, span) >= ANSWER * len(tail)
    return best, answered


def matches(texts: list[bytes], ix: Index) -> list[tuple[int, tuple[int, float, float, str]]]:
    """(text, (item, cosine, share, kind)) of each item that a text holds."""
    hashes, edges = word_hashes(texts)
    near: dict[tuple[int, int], tuple[float, set[int]]] = {}
    for t, p, b, cosine in chain(candidates(hashes, edges, ix), sharing(hashes, edges, ix)):
        top, at = near.setdefault((t, p), (0.0, set()))
        at.add(b)
        near[t, p] = max(top, cosine), at
    best: dict[tuple[int, int], tuple[float, float, str]] = {}
    for (t, p), (cosine, at) in near.items():
        own = hashes[edges[t] : edges[t + 1]].view(np.int64)
        for low, high in _spans(sorted(at), len(ix.words[p])):
            share, answered = verified(ix.words[p], ix.ends[p], own[max(0, low) : high].tolist())
            kind = "copy" if share >= COPY else "paraphrase" if share >= PARAPHRASE and answered else None
            if kind and (share, cosine) > best.get((t, ix.items[p]), (0.0, 0.0))[:2]:
                best[t, ix.items[p]] = share, cosine, kind
    return [(t, (item, cosine, share, kind)) for (t, item), (share, cosine, kind) in best.items()]


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents that hold a benchmark item: ``keep`` (default: the id; not one of these
    names) and what was found.

    Adds ``item_id``, ``cosine`` (0 where only a rare run of words led to it), ``share`` (of the item's words, in order) and ``kind``:
    ``copy`` if the share is at least COPY, or ``paraphrase`` if it is at least
    PARAPHRASE and the item's answer, its last words, is there as well. A row per
    document row and item. Windows of every whole text are compared with all
    items, ITEMS of them in each pass; windows near an item's in latent space
    are aligned word by word.

    Null and empty texts hold nothing; items without a word, or whose text or id
    is null, are not looked for. Equal items are each reported, and repeated
    document rows too. Empty tables give an empty result.
    """
    keep = keep or [id_col]
    passages = table(item_passages(items.where(F.col(item_col).isNotNull()), item_col, item_text))
    n = passages.select("item_id").distinct().count()
    weights = term_weights(docs, text) if n else (np.zeros(TERMS), 0)
    found = [_search(docs, index(part, *weights), text, keep) for part in _passes(passages, n) or [passages]]
    return reduce(DataFrame.unionByName, found)


def _search(docs: DataFrame, ix: Index, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ix)

    def run(batches):
        for batch in slices(batches, "_text"):
            rows: list[tuple] = []
            for first, texts in parts(batch):
                rows += [(first + t, *x) for t, x in matches(texts, shared.value)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in keep), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.string())],
                names=[*keep, "item_id", "cosine", "share", "kind"],
            )

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "item_id bigint, cosine double, share double, kind string"])
    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def _spans(at: list[int], words: int) -> list[tuple[int, int]]:
    """Word ranges around the windows at these blocks, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for b in at:
        low, high = b * BLOCK - words, (b + 2) * BLOCK + words
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Each row is judged by its own text, so null and repeated ids do not matter;
    a null text stays.
    """
    passages = table(item_passages(items.where(F.col("item_id").isNotNull())))
    n = passages.select("item_id").distinct().count()
    weights = term_weights(docs, text) if n else (np.zeros(TERMS), 0)
    for part in _passes(passages, n):
        docs = _mark(docs, index(part, *weights), text)
    return docs


def _passes(passages: DataFrame, n: int) -> list[DataFrame]:
    """The passages of ``n`` items in parts of about ITEMS items."""
    k = -(-n // ITEMS)
    return [passages.where(F.pmod(F.xxhash64("item_id"), F.lit(k)) == i) for i in range(k)]


def _mark(docs: DataFrame, ix: Index, text: str) -> DataFrame:
    """The rows in whose text no passage is found."""
    shared = docs.sparkSession.sparkContext.broadcast(ix)

    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ix = shared.value
        for series in texts:
            out = np.zeros(len(series), bool)
            batch = pa.RecordBatch.from_arrays([pa.array(list(series), pa.binary())], names=["_text"])
            for first, some in parts(batch):
                for t, _ in matches(some, ix):
                    out[first + t] = True
            yield pd.Series(out)

    udf = F.pandas_udf(holds, "boolean")
    return docs.where(~udf(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
