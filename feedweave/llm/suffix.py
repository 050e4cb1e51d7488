"""Suffix-array dedup: long byte strings that occur more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Filter, bounded, cut, parts, powers, slices, spread_join

#: Anchors are substrings of this many bytes.
GRAM = 40
#: An anchor is hot if over 1/HOT of all different segments have it, so there are
#: under HOT hot ones; its windows are dealt by their distance from it, PIECE by PIECE.
#: Anchors of up to LEAST_HOT segments are never hot.
HOT, LEAST_HOT, PIECE = 4096, 1000, 8
#: Anchors that a task counts before it passes them on.
AT_ONCE = 1_000_000
#: Windows that are sorted at a time.
CHUNK = 100_000


def runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """The runs of ``least``-byte windows with one anchor: a window's anchor is the
    substring of GRAM bytes in it with the smallest hash, the first of equals.

    Returns per run the text, the first window's place in it, the number of
    windows, the anchor's place after the first window, and the anchor's hash.
    Equal windows have equal anchors, as far from their start.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, wide = len(data), least - GRAM + 1
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    m, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= wide:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    if size < wide:
        m = np.minimum(m[: len(m) - (wide - size)], m[wide - size :])
    anchor = (m & low).astype(np.int64)
    begin = np.r_[0, np.cumsum(sizes)]
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - least + 1, 0))
    first = np.r_[0, np.cumsum(np.maximum(sizes - least + 1, 0))]
    start = begin[text] + np.arange(len(text)) - first[text]
    at = anchor[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(at)])
    # the smallest hashes have leading zeros: mix them anew for the filters
    key = (h[at[new]] ^ h[at[new]] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return text[new], start[new] - begin[text[new]], count, at[new] - start[new], key ^ key >> np.uint64(32)


def repeated_anchors(docs: DataFrame, least: int) -> DataFrame:
    """Hashes that are the anchor of several runs."""

    def run(batches):
        found: list[np.ndarray] = []
        for batch in slices(batches, "_text"):
            for _, texts in parts(batch):
                found.append(runs(texts, least)[4].view(np.int64))
                if sum(map(len, found)) > AT_ONCE:
                    yield counted(found)
        yield counted(found)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    sums = docs.select("_text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return cut(sums.where("n > 1").select("key"))


def segments(batch: pa.RecordBatch, least: int, anchors: Filter) -> Iterator[tuple[int, int, int, int, int, bytes, bytes, int]]:
    """(row, place, key, windows, ahead, bytes, digest, first) of the runs whose anchor may
    be repeated; ``first`` orders runs by document rank and place."""
    ranks = batch.column("_rank").to_pylist()
    for begin, texts in parts(batch):
        text, place, count, ahead, key = runs(texts, least)
        some = anchors.hits(key)
        for t, p, c, a, k in zip(*(x[some].tolist() for x in (text, place, count, ahead, key.view(np.int64)))):
            body = texts[t][p : p + c - 1 + least]
            yield begin + t, p, k, c, a, body, xxhash.xxh3_128_digest(body), (ranks[begin + t] + (1 << 63) << 32) + p


def tag(digest: bytes, first: int) -> int:
    """Names one occurrence of a segment."""
    return xxhash.xxh64_intdigest(b"%b%d" % (digest, first))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def segment_kinds(docs: DataFrame, least: int, shared: Broadcast[Filter]) -> DataFrame:
    """Different segments by anchor and digest: their number, size and first occurrence."""

    def run(batches):
        seen: dict[tuple[int, bytes], list] = {}
        for batch in slices(batches, "_text"):
            for _, _, k, c, a, _, digest, first in segments(batch, least, shared.value):
                x = seen.setdefault((k, digest), [0, first, c, a])
                x[0] += 1
                x[1] = min(x[1], first)
            if len(seen) > AT_ONCE // 10:
                yield told(seen)
        yield told(seen)

    def told(seen: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        columns = [[k for k, _ in seen], [d for _, d in seen], *([x[n] for x in seen.values()] for n in (0, 2, 3)), [b"%032x" % x[1] for x in seen.values()], [signed(tag(d, x[1])) for (_, d), x in seen.items()]]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "digest", "n", "windows", "ahead", "first", "tag"])

    rows = docs.select("_rank", "_text").mapInArrow(run, "key bigint, digest binary, n bigint, windows int, ahead int, first binary, tag bigint")
    return rows.groupBy("key", "digest", "windows", "ahead").agg(F.sum("n").alias("n"), F.min(F.struct("first", "tag")).alias("x")).select("key", "digest", "windows", "ahead", "n", "x.first", "x.tag")


def suffix_order(data: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the suffixes at ``starts``, and the longest common prefix
    of each with the one before it (the first: 0), both to a depth of ``most`` bytes.

    Every suffix has ``most`` bytes or more. Suffixes with equal first ``most``
    bytes keep the order of ``starts``.
    """
    rows = np.lib.stride_tricks.sliding_window_view(data, most)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{most}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for at in range(0, len(order) - 1, CHUNK):
        ranked = rows[order[at : at + CHUNK + 1]]
        differ = ranked[1:] != ranked[:-1]
        lcp[at + 1 : at + len(ranked)] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return order, lcp


def smaller_before(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in suffix order, the nearest one before it with a smaller
    position (-1: none), and their longest common prefix.

    Steps back by falling powers of two while no position stepped over is smaller;
    ``low`` and ``common`` hold the minima of 2**k positions and prefixes up to each place.
    """
    n = len(position)
    low, common = [position], [lcp]
    while 2 ** len(low) <= n:
        step = 2 ** (len(low) - 1)
        low.append(np.r_[low[-1][:step], np.minimum(low[-1][step:], low[-1][:-step])])
        common.append(np.r_[common[-1][:step], np.minimum(common[-1][step:], common[-1][:-step])])
    # the place reached, and the common prefix of the suffix with it
    at, shared = np.arange(n) - 1, lcp.copy()
    for k in range(len(low) - 1, -1, -1):
        go = np.flatnonzero(at >= 2**k - 1)
        go = go[low[k][at[go]] > position[go]]
        shared[go] = np.minimum(shared[go], common[k][at[go]])
        at[go] -= 2**k
    return at, np.where(at < 0, 0, shared)


def previous_factors(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array in suffix order: for each suffix the length of
    its longest match at a smaller position, and the place in suffix order of that
    match (-1: none). It is the previous or the next smaller position in suffix
    order; of two as long, the smaller one.
    """
    n = len(position)
    before, left = smaller_before(position, lcp)
    after, right = smaller_before(position[::-1], np.r_[0, lcp[:0:-1]])
    after, right = np.where(after[::-1] < 0, -1, n - 1 - after[::-1]), right[::-1]
    smaller = (after >= 0) & ((before < 0) | (position[after] < position[before]))
    second = (right > left) | ((right == left) & smaller)
    length = np.where(second, right, left)
    return length, np.where(length > 0, np.where(second, after, before), -1)


def _folded(batches, least: int) -> Iterator[list[list]]:
    """Chunks of whole groups from rows sorted by key, piece and digest: [group,
    digest, n, first, offset, bytes] for each segment or piece of one."""
    group: list[list] = []
    chunk: list[list] = []
    size = 0
    for batch in batches:
        for key, piece, digest, n, first, offset, body in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if group and group[-1][0] == (key, piece) and group[-1][1] == digest:
                x = group[-1]
                x[2], x[3], x[4], x[5] = (x[2] or n), (x[3] or first), (x[4] if body is None else offset), (x[5] or body)
                continue
            if group and group[-1][0] != (key, piece):
                chunk += group
                size += sum(len(x[5] or b"") for x in group)
                group = []
                if size > CHUNK:
                    yield chunk
                    chunk, size = [], 0
            group.append([(key, piece), digest, n, first, offset, body])
    yield chunk + group


def repeated_segments(docs: DataFrame, least: int, anchors: Broadcast[Filter]) -> DataFrame:
    """``digest``, ``low``, ``high``, ``owner``, ``origin``: of the segment with that digest
    the bytes from ``low`` to ``high`` occur again; the first time in the document of
    rank ``owner``, where the segment would start at ``origin``.

    Of an anchor whose segments are all equal that is the whole segment. Else one
    occurrence of each different segment is sent to where they are compared.
    """
    kinds = cut(segment_kinds(docs, least, anchors))
    by_key = cut(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    several = cut(kinds.join(by_key, "key"))
    spots = Filter(several, "tag")
    bar = max(LEAST_HOT, several.count() // HOT)
    hot = {r["key"] for r in by_key.where(F.col("kinds") > bar).select("key").collect()}
    shared = docs.sparkSession.sparkContext.broadcast((spots, hot))

    def sender(batches):
        spots, hot = shared.value
        for batch in slices(batches, "_text"):
            out = []
            for _, _, k, c, a, body, digest, first in segments(batch, least, anchors.value):
                if tag(digest, first) in spots:
                    out += [(k, j, digest, at, body[at : at + n - 1 + least]) for j, at, n in pieces(c, a, k in hot)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in enumerate(kinds)], names=["key", "piece", "digest", "offset", "body"])

    def judge(batches):
        for chunk in _folded(batches, least):
            # an occurrence let through by chance has no count; its segment is another row
            known = [x for x in chunk if x[2] is not None and x[5] is not None]
            out = _compare(known, least) if known else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[k] for x in out], pa.int32()) for k in (1, 2)), pa.array([(x[3] >> 32) - (1 << 63) for x in out], pa.int64()), pa.array([x[3] & 0xFFFFFFFF for x in out], pa.int64())],
                names=["digest", "low", "high", "owner", "origin"],
            )

    whole = kinds.where("n > 1").join(by_key, "key", "left_anti")
    alone = whole.select("digest", F.lit(0).alias("low"), (F.col("windows") - 1 + least).alias("high"), *ranked("first"))
    bodies = docs.select("_rank", "_text").mapInArrow(sender, "key bigint, piece int, digest binary, offset int, body binary")
    counts = several.withColumn("hot", F.col("kinds") > bar)
    low, high = F.floor((F.col("ahead") - F.col("windows") + 1) / PIECE).cast("int"), F.floor(F.col("ahead") / PIECE).cast("int")
    counts = counts.withColumn("piece", F.explode(F.when(F.col("hot"), F.sequence(low, high)).otherwise(F.array(F.lit(-1)))))
    rows = counts.select("key", "piece", "digest", "n", "first", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("binary").alias("body"))
    rows = rows.unionByName(bodies.withColumn("n", F.lit(None).cast("bigint")).withColumn("first", F.lit(None).cast("binary")))
    dealt = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "digest")
    return alone.unionByName(dealt.mapInArrow(judge, "digest binary, low int, high int, owner bigint, origin bigint"))


def ranked(column: str) -> list:
    """The rank and place that ``first`` (32 hex digits) is made of."""
    digits = F.col(column).cast("string")
    # the rank is shifted by 2**63 to be positive: flip its top bit back
    high = F.conv(F.substring(digits, 9, 16), 16, -10).cast("long")
    return [high.bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("owner"), F.conv(F.substring(digits, 25, 8), 16, 10).cast("long").alias("origin")]


def pieces(windows: int, ahead: int, hot: bool) -> Iterator[tuple[int, int, int]]:
    """(piece, first window, windows): all in one, or of a hot anchor by distance from it."""
    at = 0
    while at < windows:
        piece = (ahead - at) // PIECE if hot else -1
        n = min(windows - at, ahead - at - piece * PIECE + 1) if hot else windows
        yield piece, at, n
        at += n


def _compare(several: list[list], least: int) -> list[tuple]:
    """Intervals of the segments whose windows occur again, with the first place of each."""
    several = sorted(several, key=lambda x: int(x[3], 16) + x[4])
    first = [int(x[3], 16) + x[4] for x in several]
    data = np.frombuffer(b"".join(x[5] for x in several), np.uint8)
    sizes = np.array([len(x[5]) for x in several])
    begin = np.cumsum(sizes) - sizes
    count = sizes - least + 1
    owner = np.repeat(np.arange(len(several)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    # segments are in order of their first places, so a window's number is its position
    order, lcp = suffix_order(data, begin[owner] + offset, least)
    # one that shares too little with both neighbours has no match of ``least`` bytes
    some = (lcp >= least) | np.r_[lcp[1:] >= least, False]
    order, lcp = order[some], lcp[some]
    length, match = previous_factors(order, lcp)
    source = np.arange(len(owner))
    later = length >= least
    source[order[later]] = order[match[later]]
    again = np.array([x[2] for x in several])[owner] > 1
    again[order[later]] = again[source[order[later]]] = True
    # an earlier match may have an earlier one itself: go on to the first of all
    while (source != source[source]).any():
        source = source[source]
    origin = owner[source]
    drift = offset - offset[source]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (again[1:] != again[:-1]) | (origin[1:] != origin[:-1]) | (drift[1:] != drift[:-1])])
    out = []
    for a, b in zip(new.tolist(), np.r_[new[1:], len(owner)].tolist()):
        if again[a]:
            x = several[int(owner[a])]
            out.append((x[1], int(offset[a]) + x[4], int(offset[b - 1]) + least + x[4], first[int(origin[a])] - int(drift[a]) - x[4]))
    return out


def spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 200, keep_first: bool = True) -> DataFrame:
    """``docs``' id and text with ``spans``: the byte ranges of each to remove.

    They hold every string of ``least`` bytes (UTF-8) that occurs more than once
    in the texts, in one or in several; with ``keep_first`` not its first occurrence,
    by id and place. Overlapping ranges are merged. Strings never cross texts,
    and are judged on the texts as given.

    A null text counts as empty. Rows with a null id come first in order; equal
    ids are ordered by text hash, and of rows equal in both all are first. An
    empty table gives an empty result.
    """
    bounded(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    keyed = keyed.withColumn("_hash", F.xxhash64("_text")).withColumn("_rank", F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    long = keyed.where(F.octet_length("_text") >= least)
    shared = docs.sparkSession.sparkContext.broadcast(Filter(repeated_anchors(long, least), "key"))

    def places(batches):
        for batch in slices(batches, "_text"):
            found = [(row, p, digest) for row, p, _, _, _, _, digest, _ in segments(batch, least, shared.value)]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_rank", "_hash")), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], names=["_rank", "_hash", "place", "digest"])

    where = long.select("_rank", "_hash", "_text").mapInArrow(places, "_rank bigint, _hash bigint, place bigint, digest binary")
    repeats = repeated_segments(long, least, shared).groupBy("digest").agg(F.collect_list(F.struct("low", "high", "owner", "origin")).alias("x"))
    met = spread_join(where, repeats, "digest", "inner", F.col("place"))
    found = met.select("_rank", "_hash", "place", F.explode("x").alias("x"))
    if keep_first:
        found = found.where((F.col("x.owner") != F.col("_rank")) | (F.col("x.origin") != F.col("place")))
    ranges = found.groupBy("_rank", "_hash").agg(F.collect_set(F.struct((F.col("place") + F.col("x.low")).alias("low"), (F.col("place") + F.col("x.high")).alias("high"))).alias("_ranges"))
    joined = keyed.join(ranges.hint("shuffle_hash"), ["_rank", "_hash"], "left")
    return joined.select(F.col("_id").alias(id_col), F.col("_text"), "_ranges")


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 200, keep_first: bool = True) -> DataFrame:
    """Every document's kept bytes: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept`` (binary: cut bytes need not be valid text) and ``kept_sha256``; see :func:`spans`."""
    found = spans(docs, text, id_col, least, keep_first)
    kind = found.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "_text"):
            rows = []
            for t, ranges in zip(batch.column("_text").to_pylist(), batch.column("_ranges").to_pylist()):
                gone = merged(ranges)
                edges = [0, *(x for r in gone for x in r), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(t), len(t) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return found.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
