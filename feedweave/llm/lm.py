"""Language-model scores: a log-bilinear model with noise-contrastive training."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import bounded, cut, slices

#: The end of a text as a token; no word is empty.
END = b""
#: Words with a class of their own, classes of all others, and words that every
#: task knows by heart. The last bounds what is broadcast, not what is counted.
SINGLES, CLASSES, HEAD = 704, 319, 100_000
#: Vector length, noise samples a batch, and tokens a batch: the first FIRST, twice
#: as many after each STEPS batches, up to BATCH.
WIDTH, NOISE, BATCH, FIRST, STEPS = 16, 64, 8192, 256, 32
STEP = 0.15


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


def count_words(texts: DataFrame) -> DataFrame:
    """Every distinct token of the binary column ``_text`` with its count."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in slices(batches, "_text"):
            for t in batch.column("_text").to_pylist():
                counts.update(tokens(t))
            if len(counts) > 400_000:
                yield out(counts)
        yield out(counts)

    def out(counts):
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def bucket(word: bytes) -> int:
    """The class of a word without a class of its own: by its first bytes."""
    return SINGLES + 1 + zlib.crc32(word[:3]) % CLASSES


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows: the head of the vocabulary and sums over all of it.

    Class 0 is the end, 1 to SINGLES are frequent words, the rest hold all
    other words, seen or not, by :func:`bucket`.
    """

    head: dict[bytes, int]
    classes: np.ndarray
    log_counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def class_norm(self) -> np.ndarray:
        """log10 of a class's smoothed total, one unseen word included."""
        norm = np.log10(self.class_counts + 0.5 * (self.class_words + 1))
        norm[: SINGLES + 1] = 0.0
        return norm


def frequent(counts: DataFrame, most: int) -> list:
    """At most ``most`` of the words, the most frequent ones, by falling count.

    A histogram of counts tells from which count on they are few enough, and only
    these words come to the driver. If too many have the one largest count, it is none.
    """
    level = F.floor(F.log2("n") * 64)
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return []
    return sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Of the counts up to HEAD most frequent words, and a sum for each class."""
    top = frequent(counts, HEAD)
    end = counts.where(F.col("word") == F.lit(END)).select("n").first()
    words = [(bytes(r["word"]), r["n"]) for r in top if r["word"] != END]
    singles = [w for w, _ in words[:SINGLES]]
    mine = F.crc32(F.substring("word", 1, 3)) % CLASSES + SINGLES + 1
    by_class = counts.where(F.col("word") != F.lit(END)).groupBy(mine.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    sizes, kinds = np.zeros(SINGLES + 1 + CLASSES), np.zeros(SINGLES + 1 + CLASSES)
    for r in by_class:
        sizes[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    for k, (w, n) in enumerate(words[:SINGLES], 1):
        sizes[bucket(w)] -= n
        kinds[bucket(w)] -= 1
        sizes[k], kinds[k] = n, 1
    sizes[0] = end["n"] if end else 0
    total, distinct = int(sizes.sum()), int(kinds.sum()) + (end is not None)
    known = [(END, sizes[0]), *words] if end else words
    own = {w: k for k, w in enumerate(singles, 1)} | {END: 0}
    classes = np.array([own[w] if w in own else bucket(w) for w, _ in known] or [0], np.int16)
    logs = np.log10(np.array([n for _, n in known] or [0], float) + 0.5)
    return Vocabulary({w: k for k, (w, _) in enumerate(known)}, classes, logs, sizes, kinds, total, distinct)


def encode(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places in the head (-1: not there) and classes of a run of tokens."""
    place = np.fromiter(map(vocab.head.get, words, repeat(-1)), np.int32, len(words))
    classes = vocab.classes[place].astype(np.int32)
    for k in np.flatnonzero(place < 0).tolist():
        classes[k] = bucket(words[k]) if words[k] else 0
    return place, classes


@dataclass
class Model:
    """Log-bilinear scores of classes after two classes.

    The prediction is ``near[c1] + far[c2]``, linear in the contexts' vectors;
    a class's score is its product with ``out`` plus ``bias``.
    """

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, noise: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda: rng.normal(0, 0.1, (len(noise), WIDTH)).astype(np.float32)
        return cls(draw(), draw(), draw(), np.log(noise).astype(np.float32))

    def rows(self) -> np.ndarray:
        """All parameters, a row for each class and kind."""
        pad = np.zeros_like(self.bias)
        return np.concatenate([np.c_[self.near, pad], np.c_[self.far, pad], np.c_[self.out, self.bias]])

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Model:
        near, far, out = np.split(rows.astype(np.float32), 3)
        return cls(near[:, :-1].copy(), far[:, :-1].copy(), out[:, :-1].copy(), out[:, -1].copy())


class Trainer:
    """Noise-contrastive estimation by AdaGrad steps over batches of tokens."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.seen, self.steps = model, 0, 0
        self.cumulative = np.cumsum(noise)
        self.log_noise = (np.log(noise) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full_like(x, 1e-2) for x in (model.near, model.far, model.out, model.bias)]

    def step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        """Tell ``w`` after ``c2 c1`` from NOISE classes drawn for the whole batch."""
        m, n = self.m, len(w)
        drawn = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(max=len(self.cumulative) - 1)
        h, q, qn = m.near[c1] + m.far[c2], m.out[w], m.out[drawn]
        true = 1 / (1 + np.exp((h * q).sum(1) + m.bias[w] - self.log_noise[w]))
        false = -1 / (1 + np.exp(self.log_noise[drawn] - h @ qn.T - m.bias[drawn]))
        dh = true[:, None] * q + false @ qn
        size = len(m.bias)
        grads = [
            _scatter(c1, dh, size),
            _scatter(c2, dh, size),
            _scatter(np.r_[w, drawn], np.r_[true[:, None] * h, false.T @ h], size),
            np.bincount(w, true, size) + np.bincount(drawn, false.sum(0), size),
        ]
        for x, s, g in zip((m.near, m.far, m.out, m.bias), self.squares, grads):
            g = (g / np.sqrt(n)).astype(np.float32)
            s += g * g
            x += STEP * g / np.sqrt(s)
        self.seen += n
        self.steps += 1

    def learn(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray, rest: bool) -> int:
        """Steps over the tokens in batches; returns how many were used. With ``rest``
        the last, shorter batch is used too."""
        k = 0
        while k < len(w):
            n = min(BATCH, FIRST << min(self.steps // STEPS, 16))
            if k + n > len(w) and not rest:
                break
            self.step(c2[k : k + n], c1[k : k + n], w[k : k + n])
            k += n
        return min(k, len(w))


def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by their place."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[places[starts]] = np.add.reduceat(rows[order], starts)
    return out


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one before each token; before a text there are ends."""
    one = np.r_[0, classes[:-1]]
    return np.r_[0, one[:-1]], one


def fit(texts: DataFrame, vocab: Vocabulary) -> Model:
    """Each task trains on all its texts from one start; Spark averages the models.

    Models are weighted by their tokens. Only averaged rows, as many as there
    are classes, reach the driver.
    """
    noise = vocab.class_counts + 1.0
    noise = noise / noise.sum()
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        trainer = Trainer(Model.start(noise), noise, 1)
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in slices(batches, "_text"):
            for t in batch.column("_text").to_pylist():
                classes = encode(tokens(t), shared.value)[1]
                waiting.append((*contexts(classes), classes))
                size += len(classes)
                if size >= 16 * BATCH:
                    c2, c1, w = (np.concatenate(x) for x in zip(*waiting))
                    rest = trainer.learn(c2, c1, w, False)
                    waiting, size = [(c2[rest:], c1[rest:], w[rest:])], len(w) - rest
        if size:
            c2, c1, w = (np.concatenate(x) for x in zip(*waiting))
            trainer.learn(c2, c1, w, True)
        if trainer.seen:
            rows = trainer.m.rows().astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([trainer.seen] * len(rows), pa.int64()), *(pa.array(c) for c in rows.T)], names=names)

    names = ["row", "seen", *(f"v{k}" for k in range(WIDTH + 1))]
    schema = ", ".join(["row int, seen bigint", *(f"{c} double" for c in names[2:])])
    summed = texts.mapInArrow(run, schema).groupBy("row").agg(*[(F.sum(c) / F.sum("seen")).alias(c) for c in names[2:]])
    found = summed.collect()
    if not found:
        return Model.start(noise)
    rows = np.zeros((3 * len(noise), WIDTH + 1))
    for r in found:
        rows[r[0]] = r[1:]
    return Model.of_rows(rows)


def normalisers(spark, model: Model) -> np.ndarray:
    """log of the sum of exponentiated scores after each pair of classes."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for c2 in batch.column("id").to_pylist():
                scores = (m.near + m.far[c2]) @ m.out.T + m.bias
                most = scores.max(1, keepdims=True)
                out.append((most[:, 0] + np.log(np.exp(scores - most).sum(1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "z"])

    n = len(model.bias)
    found = spark.range(0, n, 1, 32).mapInArrow(run, "id bigint, z binary").collect()
    table = np.zeros((n, n), np.float32)
    for r in found:
        table[r["id"]] = np.frombuffer(r["z"], np.float32)
    return table


def score(docs: DataFrame, train: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Log10 probabilities of every whole text of ``docs`` by a model of ``train``.

    Returns ``keep`` (default: all columns but the text and any of these names), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed unigram) and ``score`` (the model).
    The model gives each class a probability after two tokens, normalised over
    all classes, and a word its smoothed share of its class, so that the
    probabilities of all words and one unseen word per class add up to one.

    A null or empty text is one end token. With no training rows all counts are
    zero. Equal and repeated rows are scored each by themselves.
    """
    spark = docs.sparkSession
    bounded(spark)
    counts = cut(count_words(train.select(F.col(text).cast("binary").alias("_text"))))
    vocab = vocabulary(counts)
    model = fit(train.select(F.col(text).cast("binary").alias("_text")), vocab)
    table = normalisers(spark, model)
    shared = spark.sparkContext.broadcast((vocab, model, table))
    keep = keep or [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    smooth = float(np.log10(vocab.total + 0.5 * (vocab.distinct + 1)))

    def run(batches):
        vocab, m, z = shared.value
        norm = vocab.class_norm()
        single = np.arange(len(norm)) <= SINGLES
        for batch in slices(batches, "_text"):
            columns: list[list] = [[], [], [], [], []]
            for t in batch.column("_text").to_pylist():
                words = tokens(t)
                place, w = encode(words, vocab)
                c2, c1 = contexts(w)
                logs = ((m.near[c1] + m.far[c2]) * m.out[w]).sum(1) + m.bias[w] - z[c2, c1]
                known = place >= 0
                own = np.where(known, vocab.log_counts[place], 0.0)
                inside = np.where(single[w], 0.0, own - norm[w])
                rare = [words[k] for k in np.flatnonzero(~known).tolist()]
                for out, x in zip(columns, (len(words), int(known.sum()), float(own.sum()), float(logs.sum(dtype=np.float64) / np.log(10) + inside.sum()), rare)):
                    out.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns, kinds)], names=[*keep, *names])

    names = ["n_tokens", "_known", "_own", "_part", "_rare"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint, _known bigint, _own double, _part double, _rare array<binary>"])
    partly = cut(docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    rare = partly.select("_row", F.explode("_rare").alias("word")).groupBy("word", "_row").agg(F.count("*").alias("times"))
    looked = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = looked.groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("_more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_found"))
    joined = partly.drop("_rare").join(sums, "_row", "left").na.fill(0, ["_more", "_found"])
    return joined.select(
        *keep,
        "n_tokens",
        (F.col("_known") + F.col("_found")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("_own") + F.col("_more") - F.col("n_tokens") * smooth).alias("base_score"),
        (F.col("_part") + F.col("_more")).alias("score"),
    )
