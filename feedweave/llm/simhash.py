"""SimHash near-dedup: fingerprints, and a binary trie self-join over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedweave.llm.common import FILTER_BITS, Filter, Scratch, bounded, connected_components, cut, slices, spread_join, table

SEED = 42
#: Lane tables: bit k of a byte becomes 1 in byte k of a 64-bit word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_LEAF_PAIRS, _FRONTIER, _COMPARE = 64, 1 << 20, 1 << 22


def shingle_hashes(text: bytes, width: int) -> Iterator[int]:
    """XXH64 of each shingle of ``width`` lower-cased words, repeats included.

    A text of fewer words is one shingle; one without a word has none.
    """
    tokens = text.lower().split()
    if not tokens:
        return iter(())
    if len(tokens) < width:
        return iter([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)])
    return map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(tokens[i:] for i in range(width)))), repeat(SEED))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of ``hashes``."""
    counts = np.zeros(64, np.int64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    starts = np.arange(0, len(hashes), 255)
    for k in range(8) if len(hashes) else ():
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], starts)
        counts[8 * k : 8 * k + 8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, width: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``fp``, the SimHash as a signed 64-bit number."""

    def run(batches):
        for batch in slices(batches, "_text"):
            out = [majority(np.fromiter(shingle_hashes(t or b"", width), np.uint64)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(out, np.uint64).view(np.int64))], names=[*keep, "fp"])

    bounded(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp bigint"])
    return rows.mapInArrow(run, schema)


class Trie:
    """An implicit binary trie over sorted distinct 64-bit words.

    A node of a level is a range of words with one prefix of that many bits.
    """

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, {}

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node: where it starts (with one end more), its last bit, its first child."""
        if depth not in self.levels:
            v = self.values
            starts = lambda d: np.flatnonzero(np.r_[True, (v[1:] ^ v[:-1]) >> np.uint64(64 - d) != 0] if d else np.arange(len(v)) == 0)
            own, below = starts(depth), starts(min(64, depth + 1))
            last = (v[own] >> np.uint64(64 - depth) & np.uint64(1)).astype(np.int8) if depth else np.zeros(len(own), np.int8)
            self.levels[depth] = np.r_[own, len(v)], last, np.searchsorted(below, own).astype(np.int32)
        return self.levels[depth]


class Forest:
    """Union-find over array positions, many links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        """Join the trees of linked positions; returns the links that joined two."""
        kept: list[tuple[int, int]] = []
        while len(u):
            a, b = self.root[u], self.root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            self.root[high] = np.minimum(a, b)[first]
            kept += zip(u[first].tolist(), v[first].tolist())
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up
        return kept


def trie_join(a: Trie, b: Trie, lead: int, most: int, depth_of_lead: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs that link all words of ``a`` and ``b`` near each other.

    Words are near if at most ``most`` bits differ, at most ``lead`` of them in
    the first ``depth_of_lead``. Node pairs are descended together, adding up differing
    bits; a pair beyond its budget is pruned, a small one compared word by
    word, and one whose words must all be near is linked without a look inside.
    With ``a is b`` each unordered pair is met once.
    """
    stack = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))]
    while stack:
        depth, i, j, d = stack.pop()
        if len(i) > _FRONTIER:
            stack += [(depth, i[k : k + _FRONTIER], j[k : k + _FRONTIER], d[k : k + _FRONTIER]) for k in range(0, len(i), _FRONTIER)]
            continue
        (sa, _, ca), (sb, _, cb) = a.level(depth), b.level(depth)
        na, nb = sa[i + 1] - sa[i], sb[j + 1] - sb[j]
        sure = d + 64 - depth <= most
        if depth >= depth_of_lead and sure.any():
            for x, y in zip(i[sure], j[sure]):
                left, right = np.arange(sa[x], sa[x + 1]), np.arange(sb[y], sb[y + 1])
                yield left, np.full(len(left), right[0])
                yield np.full(len(right), left[0]), right
            i, j, d, na, nb = (x[~sure] for x in (i, j, d, na, nb))
        small = na * nb <= _LEAF_PAIRS
        yield from _compare(a, b, sa[i[small]], na[small], sb[j[small]], nb[small], lead, most, depth_of_lead)
        i, j, d = i[~small], j[~small], d[~small]
        if not len(i):
            continue
        (ta, la, _), (tb, lb, _) = a.level(depth + 1), b.level(depth + 1)
        ends_a, ends_b = np.r_[ca, len(ta) - 1], np.r_[cb, len(tb) - 1]
        budget = lead if depth < depth_of_lead else most
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                p, q = ca[i] + x, cb[j] + y
                ok = (p < ends_a[i + 1]) & (q < ends_b[j + 1])
                if a is b and (x, y) == (1, 0):
                    ok &= i != j
                p, q, e = p[ok], q[ok], d[ok]
                e = e + (la[p] != lb[q])
                near = e <= budget
                parts.append((p[near], q[near], e[near].astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def _compare(a, b, start_a, na, start_b, nb, lead, most, depth_of_lead):
    sizes = na * nb
    chunk = np.cumsum(sizes) // _COMPARE
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(chunk)) + 1) if len(sizes) else ():
        n = sizes[part]
        pair = np.repeat(part, n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        u, v = start_a[pair] + k // nb[pair], start_b[pair] + k % nb[pair]
        if a is b:
            u, v = u[u < v], v[u < v]
        x = a.values[u] ^ b.values[v]
        near = (np.bitwise_count(x) <= most) & (np.bitwise_count(x >> np.uint64(64 - depth_of_lead)) <= lead)
        if near.any():
            yield u[near], v[near]


def _links(tries: list[tuple[int, int, int]], most: int, most_of_both: int | None):
    """A grouped map: links between the residents of a prefix and its visitors."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        words = group["word"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        turn, bits, errors = tries[int(group["pass"].iloc[0])]
        order = np.lexsort((words, ~home))
        values, n = words[order], int(home.sum())
        here, there = values[:n].copy(), values[n:].copy()
        second = group["second"].to_numpy().view(np.uint64)[order] if most_of_both else None
        forest, own, kept = Forest(len(values)), Trie(here), []

        def near(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
            if second is not None:
                both = np.bitwise_count(values[u] ^ values[v]) + np.bitwise_count(second[u] ^ second[v]) <= most_of_both
                u, v = u[both], v[both]
            return forest.link(u, v)

        if n:
            for u, v in trie_join(own, own, errors, most, bits):
                kept += near(u, v)
            if len(there):
                for u, v in trie_join(own, Trie(there), errors, most, bits):
                    kept += near(u, v + n)
        back = lambda x: (x >> np.uint64(turn) | x << np.uint64(64 - turn) if turn else x).view(np.int64)
        edges = np.array(kept, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": back(values[edges[:, 0]]), "b": back(values[edges[:, 1]])})

    return run


def near_links(values: DataFrame, most: int = 4, tries: list[tuple[int, int, int]] | None = None, room: int = 50_000, least_depth: int = 8, most_of_both: int | None = None) -> DataFrame:
    """Links that join the distinct fingerprints ``fp`` within ``most`` bits.

    With ``most_of_both`` there is a second word ``second`` for each, and at most so
    many bits may differ in the two together.

    A trie (rotation, bits, errors) holds the fingerprints turned left by some
    bits and meets the pairs that differ in at most ``errors`` of the first
    ``bits``. By default there are two, which together meet all pairs: at most
    ``most // 2`` of the differing bits are in the upper half, or fewer than that
    share in the lower. A trie is dealt out by its top levels: a fingerprint is
    at home in the subtrie of its prefix and a visitor in those of lesser
    prefixes within the budget. The prefix grows with the number of words, so
    that a subtrie is home to about ``room`` at most (2**20 subtries at most).
    Of each task only the links of a spanning forest leave, never all pairs.
    """
    tries = tries or [(0, 32, most // 2), (32, 32, most - most // 2 - 1)]
    n, depth = values.count(), least_depth
    while depth < 20 and n / 2**depth > room / 4:
        depth += 1
    turned = [F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", 64 - k)) if k else F.col("fp") for k, _, _ in tries]
    both = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), F.lit(e).alias("errors"), w.alias("word"), *([F.col("second")] if most_of_both else [])) for k, (w, (_, _, e)) in enumerate(zip(turned, tries))])).alias("x")).select("x.*")
    top = F.shiftrightunsigned("word", 64 - depth) if depth else F.lit(0).cast("long")
    flips: Column = F.lit(None).cast("array<int>")
    for e in sorted({e for _, _, e in tries}):
        flips = F.when(F.col("errors") == e, F.array(*[F.lit(m) for m in range(1 << depth) if m.bit_count() <= e])).otherwise(flips)
    dealt = both.withColumn("flip", F.explode(flips)).withColumn("node", top.bitwiseXOR(F.col("flip"))).where(F.col("node") <= top)
    grouped = dealt.select("pass", "node", "word", (F.col("flip") == 0).alias("home"), *(["second"] if most_of_both else [])).groupBy("pass", "node")
    return grouped.applyInPandas(_links(tries, most, most_of_both), "a bigint, b bigint")


def components(marked: DataFrame, id_col: str, most: int = 4) -> DataFrame:
    """``marked`` (``id_col``, ``fp``) with ``component_id``, the smallest id reachable."""
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = connected_components(near_links(distinct.select("fp"), most).distinct())
    roots = cut(distinct.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return spread_join(marked, named, "fp")


def simhash(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, most: int = 4) -> DataFrame:
    """Each row's fingerprint and near-duplicate component.

    Returns ``id_col``, ``fp`` (64 bits as a signed number) and
    ``component_id``. A null or wordless text has fingerprint zero and links
    like any other. Equal ids and repeated rows stay as they are, one result
    for each. A component whose ids are all null has a null ``component_id``.
    An empty table gives an empty result; other columns are not read.
    """
    marked = cut(fingerprints(docs, text, width, [id_col]))
    return components(marked, id_col, most)


def simhash_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, most: int = 4) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, as :func:`simhash` finds it; all columns.

    Rows are judged by id and text. Those with a null id stay.
    """
    marked = cut(fingerprints(docs.select(id_col, text, text_hash(text).alias("_th")), text, width, [id_col, "_th"]))
    gone = table(components(marked, id_col, most).where(F.col(id_col) != F.col("component_id")).select(id_col, "_th").distinct())
    return docs.withColumn("_th", text_hash(text)).join(gone, [id_col, "_th"], "left_anti").select(docs.columns)


#: Of the hashes that end so (mod 8) it is counted which several texts have; as
#: these are 3 in 8 and a prefix about 1 in 5, the others are seldom looked at.
COUNTED = 3
#: The most common of the shared hashes have a place of their own in the order.
COMMON, COMMON_LEAST = 100_000, 32
#: Leaders of a hash that its members are compared with in a round: one as long as a
#: round settles half of the texts, then the next numbers, the last in all further rounds.
LEADERS = (1, 32, 512)
#: Keys that are broadcast to pick sets by; of more keys the sets are dealt out.
KEYS = 1_000_000
#: Words of a set's parities.
PARITIES = 4


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.fromiter(shingle_hashes(text or b"", width), np.uint64))


class Bitmap(Filter):
    """A filter that executors pack, so that only its bits come to the driver."""

    def __init__(self, hashes: DataFrame, column: str):
        bits, n = 16, hashes.count()
        while bits < FILTER_BITS and 1 << bits < 16 * n:
            bits += 1

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            h = group["h"].to_numpy(np.int64).view(np.uint64)
            mask = np.zeros(1 << bits - 8, np.uint8)
            mask[(h >> np.uint64(64 - bits) & np.uint64((1 << bits - 8) - 1)).astype(np.int64)] = 1
            return pd.DataFrame({"w": [int(h[0] >> np.uint64(56))], "b": [np.packbits(mask, bitorder="little").tobytes()]})

        self.bits, self.words = bits, np.zeros(1 << bits - 6, np.uint64)
        size = 1 << bits - 14
        for w, b in hashes.select(F.col(column).alias("h")).groupBy(F.shiftrightunsigned("h", 56)).applyInPandas(pack, "w int, b binary").collect():
            self.words[w * size : (w + 1) * size] = np.frombuffer(b, np.uint64)


def parities(hashes: np.ndarray) -> list[int]:
    """Parities of a set's hashes by some of their bits, as signed 64-bit words.

    Two sets differ in no more of them than in elements, whatever the sets.
    """
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def shared_hashes(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``h``, the counted hashes that two different texts have, and about in how many ``n``.

    A hash leaves a slice of the texts twice at most, so that one that all texts
    have is not a load on one task.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    ways = min(1 << 16, 16 + size // (4 << 20))

    def run(batches):
        for batch in slices(batches, "_text"):
            sets = {set_key(u): u[u & np.uint64(7) < COUNTED] for u in (shingle_set(t, width) for t in batch.column("_text").to_pylist())}
            h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            way = (h >> np.uint64(3)) % np.uint64(ways)
            order = np.argsort(way, kind="stable")
            found, at = np.unique(way[order], return_index=True)
            packed = [x.tobytes() for x in np.split(h[order], at[1:])] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(packed, pa.binary())], names=["way", "hashes"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(np.frombuffer(b"".join(group["hashes"]), np.uint64), return_counts=True)
        return pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    bounded(docs.sparkSession)
    packed = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "way bigint, hashes binary")
    return packed.groupBy("way").applyInPandas(count, "h bigint, n bigint")


def prefixes(docs: DataFrame, text: str, width: int, id_col: str, similarity: float, work: Scratch) -> DataFrame:
    """``id_col``, the text's hash ``_th``, the ``key`` of its shingle set, its ``size``, ``prefix``, ``sign`` (parities) and ``hashes``.

    All hashes have one order: those of one text only, the shared ones, the common
    ones by count, those that were not counted. Sets of at least ``similarity``
    meet in the first ``size - ceil(similarity * size) + 1`` hashes of each. What
    no other text has cannot meet, so it is left out; where nothing is left, the
    text is near to no other, and ``prefix``, ``sign`` and ``hashes`` are null.
    """
    shared = work.table(shared_hashes(docs, text, width))
    least, more = COMMON_LEAST, 0
    for level, count in sorted(shared.where(F.col("n") >= least).groupBy(F.floor(F.log2("n"))).count().collect(), reverse=True):
        more += count
        if more > COMMON:
            least = 2 << level
            break
    common = shared.where(F.col("n") >= least).toPandas()
    known, times = common["h"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    order = np.argsort(known)
    sent = docs.sparkSession.sparkContext.broadcast((Bitmap(shared, "h"), known[order], times[order]))

    def prefix(u: np.ndarray) -> np.ndarray:
        maybe, known, times = sent.value
        first = len(u) - int(np.ceil(similarity * len(u) - 1e-9)) + 1 if len(u) else 0
        counted = u & np.uint64(7) < COUNTED
        low = u[counted]
        met = low[maybe.hits(low)]
        room = first - (len(low) - len(met))
        if room <= 0:
            return u[:0]
        rank = np.zeros(len(met), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, met), len(known) - 1)
            rank = np.where(known[at] == met, times[at], 0)
        return np.concatenate([met[np.lexsort((met, rank))], u[~counted]])[:room]

    def run(batches):
        for batch in slices(batches, "_text"):
            keys, sizes, firsts, signs, sets = [], [], [], [], []
            for t in batch.column("_text").to_pylist():
                u = shingle_set(t, width)
                p = prefix(u)
                keys.append(set_key(u))
                sizes.append(len(u))
                firsts.append(p.view(np.int64) if len(p) else None)
                signs.append(parities(u) if len(p) else None)
                sets.append(u.tobytes() if len(p) else None)
            made = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_th"), *made], names=[id_col, "_th", "key", "size", "prefix", "sign", "hashes"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_hash(text).alias("_th"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, _th bigint, key bigint, size bigint, prefix array<bigint>, sign array<bigint>, hashes binary")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of shingle hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def followers(sets: DataFrame, hashes: DataFrame, similarity: float, id_col: str, work: Scratch) -> DataFrame:
    """The keys of ``sets`` that go: each is like one of a smaller ``owner`` that stays.

    In a round the members of a hash are compared with its first few, the
    leaders, never all with all. A text that leads in all its hashes was
    compared with all that it can be like. If nothing that it is like
    comes before it, it stays, and those like it go. Who is neither, waits for the
    next round. The first of all always stays, so no text is left unjudged.
    While one leader a hash settles enough texts, members meet only such leaders
    as are the first in all their hashes and so sure to stay. Where many texts
    share a hash and are not alike, rounds take more leaders.

    Sizes, and parities of the sets, rule out most pairs that are not alike before
    whole sets (``hashes`` by ``key``, which may repeat) are sent to where they are
    compared.

    What a round leaves is written as tables, not checkpoints: the planner knows
    their sizes, and reads many small files as one partition, so late rounds over few
    texts are cheap however many partitions the first ones had.
    """

    def judge(batches):
        for batch in batches:
            like = [resemblance(a, b) >= similarity for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    bounded(sets.sparkSession)
    signs = [f"s{k}" for k in range(PARITIES)]
    facts = work.table(sets.select("key", "size", *[F.get("sign", F.lit(k)).alias(s) for k, s in enumerate(signs)]))
    side = lambda key, mark: facts.select(F.col("key").alias(key), *[F.col(c).alias(f"{mark}{c}") for c in ("size", *signs)])

    def may(other: Callable[[str], Column]) -> Column:
        """Whether a text and another, whose columns ``other`` gives, may be alike."""
        size, its = F.col("size"), other("size")
        differ = reduce(Column.__add__, [F.bit_count(F.col(s).bitwiseXOR(other(s))) for s in signs])
        return (its >= size * similarity - 1e-6) & (size >= its * similarity - 1e-6) & (differ <= (size + its) * (1 - similarity) / (1 + similarity) + 1e-6)

    def held(pairs: DataFrame, side: str) -> DataFrame:
        """The sets of one side of the pairs; the others are left out before they are dealt."""
        keys, own = pairs.select(side).distinct(), hashes.withColumnRenamed("key", side)
        return own.join(F.broadcast(keys) if keys.count() <= KEYS else keys, side, "left_semi").dropDuplicates([side])

    spark = sets.sparkSession

    def alike(pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """Those pairs of a leader ``a`` and a later text ``b`` that are alike."""
        pairs = scratch.table(pairs)
        pairs_b = pairs.join(held(pairs, "b").withColumnRenamed("hashes", "_b"), "b")
        both = spread_join(pairs_b, held(pairs, "a").withColumnRenamed("hashes", "_a"), "a", "inner", F.col("b"))
        return scratch.table(both.select("a", "b", "_a", "_b").mapInArrow(judge, "a bigint, b bigint"))

    def in_order(left: DataFrame, scratch: Scratch) -> DataFrame:
        """Each member of a hash with the hash's first text, ``lead``; hashes of one text left out.

        Of hashes with the same members (as 128 bits of sums of their keys' hashes tell) one is enough.
        """
        members = [F.sum(F.xxhash64(F.lit(k), "key").cast("decimal(38,0)")).alias(f"_m{k}") for k in range(2)]
        first = left.groupBy("h").agg(F.min(F.struct("owner", "key")).alias("_f"), F.count("*").alias("_n"), *members).where("_n > 1")
        one = first.groupBy("_n", "_m0", "_m1").agg(F.min("h").alias("h"), F.min("_f.key").alias("lead"))
        return scratch.table(left.join(one.select("h", "lead"), "h"))

    scratch = Scratch(spark)
    led = in_order(sets.select(F.explode("prefix").alias("h"), "key", F.col("owner")[id_col].alias("owner")), scratch)
    gone, turn, n = [], 0, led.select("key").distinct().count()
    while n:
        if LEADERS[turn] == 1:
            sure = scratch.table(led.groupBy("key").agg(F.min(F.col("lead") == F.col("key")).alias("_sure")).where("_sure").select("key"))
            pairs = led.where("lead <> key").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct().join(sure.select(F.col("key").alias("a")), "a", "left_semi")
            may_be = pairs.join(side("b", ""), "b").join(side("a", "_"), "a").where(may(lambda c: F.col(f"_{c}"))).select("a", "b")
            went = [work.table(alike(may_be, scratch).select(F.col("b").alias("key")).distinct())]
            done = sure.unionByName(went[0])
        else:
            left = led.select("h", "key", "owner").join(facts, "key")
            place = F.row_number().over(Window.partitionBy("h").orderBy("owner", "key"))
            leads = scratch.table(left.withColumn("_n", place).where(F.col("_n") <= LEADERS[turn]).drop("_n"))
            first = leads.groupBy("h").agg(F.collect_list(F.struct("owner", "key", "size", *signs)).alias("_l"))
            before = lambda x: (F.struct(x["owner"], x["key"]) < F.struct("owner", "key")) & may(lambda c: x[c])
            met = left.join(first, "h").select("key", F.transform(F.filter("_l", before), lambda x: x["key"]).alias("_a")).where(F.size("_a") > 0)
            # two texts meet at many hashes; merged by text, they leave as one pair
            pairs = met.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("_a"))).alias("_a")).select(F.explode("_a").alias("a"), F.col("key").alias("b"))
            places = leads.groupBy("key").agg(F.count("*").alias("_led"))
            lead = scratch.table(led.groupBy("key").agg(F.count("*").alias("_all")).join(places, "key").where("_led = _all").select("key"))
            links, went = alike(pairs, scratch), []
            while True:
                top = links.select("a").distinct().join(lead.select(F.col("key").alias("a")), "a", "left_semi").join(links.select(F.col("b").alias("a")), "a", "left_anti")
                less = work.table(links.join(top, "a", "left_semi").select(F.col("b").alias("key")).distinct())
                if less.isEmpty():
                    break
                went.append(less)
                links = scratch.table(links.join(less.select(F.col("key").alias("b")), "b", "left_anti").join(less.select(F.col("key").alias("a")), "a", "left_anti"))
            kept = lead.join(links.select(F.col("b").alias("key")), "key", "left_anti")
            done = reduce(DataFrame.unionByName, [kept, *went])
        gone += went
        had, round, scratch = n, scratch, Scratch(spark)
        led = in_order(led.drop("lead").join(done.distinct(), "key", "left_anti"), scratch)
        n = led.select("key").distinct().count()
        round.clear()
        if 2 * n > had:
            turn = min(turn + 1, len(LEADERS) - 1)
    scratch.clear()
    return reduce(DataFrame.unionByName, gone) if gone else sets.select("key").limit(0)


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates of rows with a smaller id; all columns.

    Texts are alike if the Jaccard similarity of their sets of shingles (by 64-bit
    hashes) is at least ``similarity``. By rising id, a text stays unless it is
    like one that stays. All such pairs are met, however many texts there are: by a
    join on the rarest shingles of each, and each is decided on the whole sets.

    Rows are judged by id and text: of several rows with one id those with
    different texts are judged apart, and of equal ones one stays. Rows with a null
    id stay and lead none. Texts without words are alike. An empty table gives an
    empty result.
    """
    work = Scratch(docs.sparkSession)
    marked = work.table(prefixes(docs, text, width, id_col, similarity, work))
    named = marked.where(F.col(id_col).isNotNull())
    owners = work.table(named.groupBy("key").agg(F.min(F.struct(id_col, "_th")).alias("owner")))
    held = named.where(F.col("prefix").isNotNull())
    sets = work.table(held.drop("hashes").join(owners, "key").where(F.struct(id_col, "_th") == F.col("owner")).dropDuplicates(["key"]).select("key", "owner", "size", "prefix", "sign"))
    judged = owners.join(followers(sets, held.select("key", "hashes"), similarity, id_col, work).withColumn("like", F.lit(True)), "key", "left")
    mine = F.struct(F.col(id_col), F.col("_th")) == F.col("owner")
    found = spread_join(named.select(id_col, "_th", "key"), judged, "key").groupBy(id_col, "_th").agg(F.max(F.coalesce("like", F.lit(False)) | ~mine).alias("goes"), F.count("*").alias("n"))
    found = work.table(found)
    gone = table(found.where("goes").select(id_col, "_th"))
    twice = table(found.where("not goes and n > 1").select(id_col, "_th"))
    work.clear()
    rows = docs.withColumn("_th", text_hash(text))
    stay = rows.join(gone, [id_col, "_th"], "left_anti")
    if twice.isEmpty():
        return stay.select(docs.columns)
    once = stay.join(twice, [id_col, "_th"], "left_anti").select(docs.columns)
    return once.unionByName(stay.join(twice, [id_col, "_th"], "left_semi").dropDuplicates([id_col, "_th"]).select(docs.columns))
