"""Collocations: phrases of two to four words that occur together, for each language.

Words that occur often enough in their language are dictionary-encoded as 64-bit
ids; all others break the text, as no frequent phrase holds one. The encoded text is written once. Runs of ids are
packed into fixed-width binary keys, sorted by radix and run-length counted in every
task, sent to range partitions of the keys, sorted there and run-length counted again.
Longer phrases are only counted where both of their parts of one word less are frequent.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import Filter, bounded, slices, spread_join, table

LONGEST = 4
#: Upper case becomes lower case, what ends a piece a full stop, the tab a space.
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Words, or keys, that a task holds before it sends what it has counted, and rows that it sends at once.
MOST_WORDS, MOST_KEYS, SENT = 1 << 18, 1 << 20, 1 << 16
#: Words of a block of encoded text, and words that are counted at once. Parquet's writer and reader hold many rows,
#: so rows are short, and row groups of the encoded text are small and looked at row by row.
BLOCK, AT_ONCE = 1 << 13, 1 << 19
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16", "parquet.enable.dictionary": "false"}
#: Odd multipliers that mix the words behind the first into a key's leading number.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
UND = "und"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased, and a full stop between pieces, which is no word."""
    return text.translate(_PIECES).replace(b".", b" . ").split()


def word_id(word: bytes, lang: int) -> int:
    """A word's id in a language, whose seed is ``lang``. Never 0, which breaks runs."""
    return xxhash.xxh64_intdigest(word, lang) or 1


def language_seed(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    bounded(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("_lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))


def dictionary(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", seed: int = 42, encode: Callable[[bytes, int], int] = word_id) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words ``(lang, id, word, n)``, all words of each language ``(lang, n)``, and the seed.

    Ids are 64-bit hashes that are proved to be unique: were a frequent word's id that of
    another word, the words are encoded anew with the next seed.
    """
    rows = _rows(docs, text, lang)

    def run(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        counted: dict[str, Counter] = defaultdict(Counter)

        def flush():
            while counted:
                name, words = counted.popitem()
                start, total = language_seed(name, seed), words.total()
                rows = chain(((encode(w, start), w, n) for w, n in words.items()), [(0, None, total)])
                while part := list(islice(rows, SENT)):
                    ids, found, n = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["lang", "id", "word", "n"])

        for batch in slices(batches, "_text"):
            for name, body in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                counted[name].update(body.translate(_PIECES).replace(b".", b" ").split())
            if sum(map(len, counted.values())) > MOST_WORDS:
                yield from flush()
        yield from flush()

    while True:
        sent = rows.mapInArrow(lambda batches, seed=seed: run(batches, seed), "lang string, id bigint, word binary, n bigint")
        summed = sent.groupBy("lang", "id").agg(F.sum("n").alias("n"), F.min("word").alias("word"), (F.min("word") != F.max("word")).alias("shared"))
        found = table(summed.where((F.col("n") >= least) | (F.col("id") == 0)))
        frequent, totals = found.where("id <> 0"), found.where("id = 0").select("lang", "n")
        # across languages, too: keys do not name the language
        twice = frequent.groupBy("id").agg(F.count("*").alias("c"), F.max("shared").alias("s")).where("c > 1 or s")
        if twice.isEmpty():
            return frequent.drop("shared"), totals, seed
        seed += 1


def leading(runs: list[np.ndarray]) -> np.ndarray:
    """A key's first number: the first id plus a mix of the others.

    The key's other numbers are the other ids as they are, so that the first id can be had back.
    It is even over all phrases, those of one first word too, so fixed ranges of it are.
    """
    out = runs[0].copy()
    for r, m in zip(runs[1:], _MIX):
        x = r * m
        out += x ^ (x >> np.uint64(29))
    return out


def radix_order(column: np.ndarray) -> np.ndarray:
    """An order of rows by the upper half of 64-bit numbers: a radix sort, 16 bits a pass."""
    order = np.argsort((column >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    return order[np.argsort((column >> np.uint64(48)).astype(np.uint16)[order], kind="stable")]


def runs(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows, and how often each occurs (``n``: occurrences of the given rows).

    Rows are sorted by the upper half of their leading number. Two that differ and share it may part a run, which
    is then two rows; the last count, which sorts whole keys, makes that good.
    """
    order = radix_order(columns[0])
    columns = list(columns)
    for i in range(len(columns)):  # one at a time, so that what is not needed any more goes
        columns[i] = columns[i][order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.r_[starts, len(order)]) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n
    return [c[starts] for c in columns], counts


def packed(columns: list[np.ndarray]) -> pa.Array:
    """Rows of 64-bit numbers as binary keys that sort alike."""
    width = 8 * len(columns)
    body = np.ascontiguousarray(np.stack(columns, 1)).astype(">u8").tobytes()
    ends = np.arange(0, len(body) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)])


def encoded(docs: DataFrame, words: Filter, seed: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """Blocks of text as ``ids``, eight bytes a word; 0 stands between pieces and for words that are not frequent.

    A block has :data:`BLOCK` words, in ``own``, and those after them that a phrase of its last words may hold.
    ``words`` may hold more than the frequent ones, which costs time and is made good by the counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # frequent words only: the others are most of the different words, but few of the text
        known: dict[str, dict[bytes, int]] = {}
        for batch in slices(batches, "_text"):
            found: list[int] = []
            for name, body in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                ids = known.setdefault(name, {b".": 0})
                tokens = words_of(body)
                new = list(set(tokens).difference(ids))
                if new:
                    start = language_seed(name, seed)
                    made = np.array([word_id(w, start) for w in new], np.uint64)
                    ids.update((new[i], int(made[i])) for i in shared.value.hits(made))
                found.extend(map(ids.get, tokens, repeat(0)))
                found.append(0)
            if sum(map(len, known.values())) > MOST_WORDS:
                known.clear()
            kept = np.array(found, np.uint64)
            # one break is as good as many
            kept = kept[(kept != 0) | np.r_[True, kept[:-1] != 0]]
            starts = range(0, len(kept), BLOCK)
            blocks = [kept[a : a + BLOCK + LONGEST - 1].tobytes() for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array([min(BLOCK, len(kept) - a) for a in starts], pa.int32())], names=["ids", "own"])

    return _rows(docs, text, lang).mapInArrow(run, "ids binary, own int")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks together, about :data:`AT_ONCE` words at a time, with a break between them, and which words are a block's own."""
    parts: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for body, own in zip(batch.column("ids").to_pylist(), batch.column("own").to_pylist()):
            ids = np.frombuffer(body, np.uint64)
            parts += [ids, np.zeros(1, np.uint64)]
            marks.append(np.arange(len(ids) + 1) < own)
            size += len(ids)
            if size >= AT_ONCE:
                yield np.concatenate(parts), np.concatenate(marks)
                parts, marks, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(marks)


def phrases(blocks: DataFrame, size: int, least: int, parts: Filter | None) -> DataFrame:
    """Phrases of ``size`` words that occur at least ``least`` times: ``ids``, ``head`` and ``n``.

    ``parts`` holds the heads of frequent phrases of a word less, and maybe more.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, held, room = shared.value, [], 0

        def flush():
            n = np.concatenate([n for _, n in held])
            columns = [[k[i] for k, _ in held] for i in range(size)]
            held.clear()
            keys, n = runs([np.concatenate(columns.pop(0)) for _ in range(size)], n)
            for at in range(0, len(n), SENT):
                part = [k[at : at + SENT] for k in keys]
                yield pa.RecordBatch.from_arrays([packed(part), pa.array(n[at : at + SENT])], names=["key", "n"])

        for ids, own in gathered(batches):
            there = ids != 0
            # where a phrase may begin: frequent words only, then frequent parts only
            fits = (there & own)[: max(0, len(ids) - size + 1)]
            for k in range(1, size):
                fits &= there[k : k + len(fits)]
            at = np.flatnonzero(fits)
            if shorter is not None and len(at):
                part = np.zeros(len(ids), bool)
                begins = np.union1d(at, at + 1)
                part[begins[shorter.hits(leading([ids[begins + k] for k in range(size - 1)]))]] = True
                at = at[part[at] & part[at + 1]]
            if len(at):
                columns = [ids[at + k] for k in range(size)]
                held.append(runs([leading(columns), *columns[1:]]))
                room += len(held[-1][1])
            if room > MOST_KEYS:
                yield from flush()
                room = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted keys: equal ones follow each other, from one batch to the next too."""
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column("key"), batch.column("n").to_numpy()
            first, end = keys.offset, keys.offset + len(keys)
            marks = np.frombuffer(keys.buffers()[1], np.int32)[first : end + 1]
            body = np.frombuffer(keys.buffers()[2], np.uint8)[marks[0] : marks[-1]].reshape(len(keys), -1).view(">u8")
            starts = np.flatnonzero(np.r_[True, (body[1:] != body[:-1]).any(1)])
            sums = np.add.reduceat(n, starts)
            mine = [tuple(map(int, body[starts[0]]))]
            if last is not None and last == mine[0]:
                sums[0] += total
            elif last is not None and total >= least:
                yield send(np.array([last], np.uint64), np.array([total]))
            last, total = tuple(map(int, body[starts[-1]])), int(sums[-1])
            enough = np.flatnonzero(sums[:-1] >= least)
            if len(enough):
                yield send(body[starts[enough]].astype(np.uint64), sums[enough])
        if last is not None and total >= least:
            yield send(np.array([last], np.uint64), np.array([total]))

    def send(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ids = keys.copy()
        ids[:, 0] -= leading([np.zeros(len(keys), np.uint64), *keys[:, 1:].T])
        flat = pa.array(ids.view(np.int64).ravel())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, size, dtype=np.int32)), flat), pa.array(keys[:, 0].copy().view(np.int64)), pa.array(n.astype(np.int64))], names=["ids", "head", "n"])

    sent = blocks.mapInArrow(count, "key binary, n bigint")
    ranges = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    dealt = sent.repartitionById(ranges, F.shiftright(place * ranges, 32).cast("int")).sortWithinPartitions("key")
    return dealt.mapInArrow(merge, "ids array<bigint>, head bigint, n bigint")


def counted(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All frequent phrases ``(ids, n)`` of one to :data:`LONGEST` words, the dictionary, and the languages' totals."""
    words, totals, seed = dictionary(docs, least, text, lang, seed)
    blocks, shorter = table(encoded(docs, Filter(words, "id"), seed, text, lang), **SMALL_GROUPS), None
    found = words.select(F.array("id").alias("ids"), "n")
    for size in range(2, LONGEST + 1):
        level = table(phrases(blocks, size, least, shorter))
        shorter = Filter(level, "head")
        found = found.unionByName(level.select("ids", "n"))
    return found, words, totals


def scored(found: DataFrame) -> DataFrame:
    """Candidates ``ids, a, l, r, score`` by the cut with the lowest score (ties: the first)."""
    size = F.size("ids")
    cuts = found.where(size > 1).select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("right"))
    # a short part, or one frequent word, can be part of many phrases
    cuts = spread_join(cuts, found.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left", "inner", salt="ids")
    cuts = spread_join(cuts, found.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right", "inner", salt="ids")
    # in decimals: twice a million counts may pass 64 bits
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r) as bigint)")
    best = cuts.withColumn("score", score).groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("ids", "b.a", "b.l", "b.r", "b.score")


def whole(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates that no longer one holds that occurs ``percent`` as often."""
    parts = None
    for size in range(3, LONGEST + 1):
        longer = candidates.where(F.size("ids") == size)
        for part in range(2, size):
            inside = longer.select(F.explode(F.array(*[F.slice("ids", k + 1, part) for k in range(size - part + 1)])).alias("ids"), F.col("a").alias("most"))
            parts = inside if parts is None else parts.unionByName(inside)
    held = parts.groupBy("ids").agg(F.max("most").alias("most"))
    return candidates.join(held, "ids", "left").where(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < percent * F.col("a").cast("decimal(20,0)"))).drop("most")


def spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with ``lang`` and ``phrase`` instead of ``ids``."""
    kept = [c for c in candidates.columns if c != "ids"]
    placed = candidates.select("ids", *kept, F.posexplode("ids").alias("pos", "id"))
    named = spread_join(placed, words.select("id", "lang", F.col("word").cast("string").alias("word")), "id", "inner", salt="ids")
    out = named.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), *[F.first(c).alias(c) for c in kept])
    return out.select("lang", F.array_join("w.word", " ").alias("phrase"), *kept)


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, percent: int = 80, text: str = "text", lang: str = "lang", seed: int = 42) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases.

    Words are runs of anything but spaces and tabs, inside pieces that end at a line
    break or one of ``.,;:!?``; A to Z are lower-cased. A candidate is a phrase of two to four words that occurs
    ``a >= least`` times in its language; ``l`` and ``r`` count the parts of its cut with the lowest
    score, ``2000000 * a / (l + r)`` rounded down; ``n`` counts all words of the language.
    Ties go to the smaller phrase by its bytes.

    Null texts are empty; a null language is ``und``, like one of that name. Very long
    texts and words are taken whole; repeated rows count as often as they occur; an empty
    table gives no rows; other columns are ignored, whatever their names. What is broadcast are two bitmaps of at most 32 MB.
    """
    found, words, totals = counted(docs, least, text, lang, seed)
    candidates = table(scored(found))
    named = spelled(whole(candidates, percent), words)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    first = named.withColumn("rank", order.cast("long")).where(F.col("rank") <= most)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
