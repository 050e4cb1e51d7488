"""Language identification: naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import bounded, parts, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages that one model may have: it holds BUCKETS numbers for each.
MOST_LANGUAGES = 2000
#: Products that are made at a time.
CELLS = 1 << 20
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of a text, lower-cased.

    Runs of ASCII characters that are not letters count as one space, and the
    text has a space on either side.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    other = (points < 128) & ~((points >= 97) & (points <= 122))
    points = np.where(other, np.uint32(32), points)
    points = np.concatenate([[32], points[~(other & np.r_[False, other[:-1]])], [32]]).astype(np.uint32)
    found, h = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint32(n)) * _MIX[n % 3]
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            found.append(h * np.uint32(0x27D4EB2F) >> np.uint32(17))
    return np.concatenate(found)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.decode("utf-8", "replace") for t in batch.column("_text").to_pylist())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities: a row for each, a column per bucket.

    All rows with a text and a language are counted; tasks add up the buckets of
    their rows, and Spark sums those. What reaches the driver is bounded by the
    number of languages, which is checked, times :data:`BUCKETS`. Languages are
    taken as equally likely beforehand.
    """
    bounded(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).cast("binary").alias("_text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "_text"):
            for name, t in zip(batch.column("_lang").to_pylist(), _texts(batch)):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name] += np.bincount(grams(t), minlength=BUCKETS)
            if len(sums) > 100:
                yield from flush(sums)
        yield from flush(sums)

    def flush(sums):
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
        sums.clear()

    summed = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).select("lang", "c.bucket", "c.n")
    found = packed.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    table = np.zeros((len(found), BUCKETS))
    for row, r in zip(table, found):
        row[np.array(r["bucket"], int)] = r["n"]
    table += smoothing
    return [r["lang"] for r in found], np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if len(found) else table


def posteriors(texts: list[np.ndarray], by_bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each text (not empty) by its buckets, and how probable it is.

    The texts' counts are a sparse matrix, a row for each, that is multiplied with
    the log probabilities of all languages: its entries' products are added up by
    row, CELLS of them at a time.
    """
    sizes = np.array([len(x) for x in texts])
    places = np.repeat(np.arange(len(texts)), sizes) * BUCKETS + np.concatenate(texts).astype(np.int64)
    entries, counts = np.unique(places, return_counts=True)
    row, bucket = entries // BUCKETS, entries % BUCKETS
    fit = np.zeros((len(texts), by_bucket.shape[1]))
    step = max(1, CELLS // by_bucket.shape[1])
    for k in range(0, len(entries), step):
        held = row[k : k + step]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        fit[held[starts]] += np.add.reduceat(counts[k : k + step, None] * by_bucket[bucket[k : k + step]].astype(np.float64), starts)
    best = fit.argmax(1)
    top = fit[np.arange(len(fit)), best]
    return best, 1 / np.exp(np.minimum(fit - top[:, None], 0)).sum(1)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but any of these names), ``lang_pred`` and ``score``.

    The score is the posterior probability of the predicted language. A text
    that is null or has no letter gets ``und`` and 0, as does every text if no
    language was learned. Of languages that fit alike the first by name wins.
    """
    languages, table = model
    keep = keep or [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def run(batches):
        by_bucket = shared.value
        for batch in slices(batches, "_text"):
            lettered = batch.column("_letter").to_pylist()
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for first, texts in parts(batch):
                some = [k for k, t in enumerate(texts) if lettered[first + k] and languages]
                if some:
                    best, sure = posteriors([grams(texts[k].decode("utf-8", "replace")) for k in some], by_bucket)
                    at = first + np.array(some)
                    names[at], scores[at] = [languages[k] for k in best], sure
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    return rows.mapInArrow(run, schema)
