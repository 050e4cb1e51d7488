"""Line dedup by a segment-partition edit join, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import cut, spread_join, table
from feedweave.llm.quality import let

#: Words of the bitmaps that thin out texts before a shuffle: 2**16 numbers of 64
#: bits, 1 MB, however many lines there are. A full one only thins out less.
WORDS = 1 << 16
#: Lines of a key that are compared in one group; a key of more is dealt over several.
MEMBERS = 256
WORD = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, and every line with a word: its number ``no``, ``line``, hash ``h``."""
    exploded = docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    return exploded.where(F.col("line").rlike(WORD)).withColumn("h", F.xxhash64("line"))


def bitmap(ids: DataFrame, column: str = "h") -> DataFrame:
    """A table of at most WORDS rows: a bit for each hash in a column, by its leading bits."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 42) & 63 as int))")
    return cut(ids.groupBy(F.shiftrightunsigned(column, 48).alias("_w")).agg(F.bit_or(bit).alias("_bits")))


def marked(rows: DataFrame, bits: DataFrame, column: str = "h") -> DataFrame:
    """``rows`` with ``_hit``: whether the bit of their hash is set."""
    hit = F.expr(f"(shiftrightunsigned(_bits, cast(shiftrightunsigned({column}, 42) & 63 as int)) & 1) = 1")
    return rows.join(F.broadcast(bits), F.shiftrightunsigned(column, 48) == F.col("_w"), "left").withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_w", "_bits")


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``h``, ``key`` and ``own``: what a line of ``lines`` (``h``, ``line``, ``_n``) is looked up by, and whether as itself.

    A line within ``edits`` edits of one of length ``n`` keeps one of that line's
    ``edits + 1`` even segments whole. Segment ``i`` can only have moved so far
    that the edits before and behind it, ``edits`` in all, explain the move. So
    there are few substrings to probe for each length, up to ``edits`` less than
    its own, and segment; those that did not move at its own length are its own
    segments, the index. The probes are rows of a literal array, which keeps the
    generated code small enough to be compiled.
    """
    probes = [(i, less, move) for i in range(edits + 1) for less in range(edits + 1) for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)]
    literal = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(move).alias("move")) for i, less, move in probes])
    rows = lines.select("h", "line", "_n", F.explode(literal).alias("p"))
    length, i, parts = F.col("_n") - F.col("p.less"), F.col("p.i"), edits + 1
    short, base = parts - length % parts, F.floor(length / parts).cast("int")  # the first ones are the shorter
    start = base * i + F.greatest(i - short, F.lit(0)) + 1 + F.col("p.move")
    size = base + F.when(i >= short, 1).otherwise(0)
    inside = (start >= 1) & (start + size - 1 <= F.col("_n"))
    own = (F.col("p.less") == 0) & (F.col("p.move") == 0)
    return rows.where(inside).select("h", F.xxhash64(length, i, F.substring(F.col("line"), start, size)).alias("key"), own.alias("own"))


def signature(line: Column) -> Column:
    """Parities of a line's characters, pairs and triples, 64 of each, dealt by hash.

    An edit flips two at most of characters, four of pairs and six of triples.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def of(c: Column, k: int) -> Column:
        bit = lambda i: F.call_function("shiftleft", one, F.pmod(F.xxhash64(*[F.get(c, i + j) for j in range(k)]), F.lit(64)).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(c) - k, F.lit(0))), zero, lambda a, i: a.bitwiseXOR(bit(i)))

    return let(F.split(line, ""), lambda c: F.array(*[of(c, k) for k in (1, 2, 3)]))


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two signatures differ in no more bits than ``edits`` edits can flip."""
    out = F.lit(True)
    for k in (1, 2, 3):
        out &= F.bit_count(F.get(a, F.lit(k - 1)).bitwiseXOR(F.get(b, F.lit(k - 1)))) <= 2 * k * edits
    return out


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two texts if it is at most ``most``, else a larger number.

    Bit-parallel within a band: bit ``k`` of the words holds row ``j - most + k``
    of the matrix, relative to the diagonal of column ``j``; a column is a few
    bit operations on words of ``2 * most + 1`` bits. Lengths may differ by up to
    ``most``; the band starts on the diagonal and slides down it, and below the
    end of ``a`` the count is followed along the last row.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")

    def of(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)

        def step(s: Column, j: Column) -> Column:
            c = F.get(y, j)
            hit = lambda k: F.when((j + (k - most) >= 0) & (F.get(x, j + (k - most)) == c), long(1 << k)).otherwise(long(0))
            match = hit(0)
            for k in range(1, width):
                match = match.bitwiseOR(hit(k))
            vp, vn = s["vp"], s["vn"]
            flip = lambda z: z.bitwiseXOR(long(full))
            return let(
                match,
                lambda e: let(
                    (e.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(long(full)),
                    lambda d0: let(
                        F.struct(vn.bitwiseOR(flip(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"), F.shiftright(d0, 1).alias("down")),
                        lambda h: F.struct(
                            h["hn"].bitwiseOR(flip(h["down"].bitwiseOR(h["hp"]))).alias("vp"),
                            h["down"].bitwiseAND(h["hp"]).alias("vn"),
                            (s["d"] + _change(d0, h["hp"], h["hn"], j, m, most)).alias("d"),
                        ),
                    ),
                ),
            )

        start = F.struct(long(full - ((1 << most) - 1)).alias("vp"), long(0).alias("vn"), F.least(F.lit(most), m).alias("d"))
        return F.when(F.abs(m - n) > most, F.lit(most + 1)).when(n == 0, m).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["d"]))

    chars = lambda t: F.split(t, "")
    pieces = F.array(F.struct(F.when(F.length(a) > 0, chars(a)).otherwise(F.array().cast("array<string>")).alias("x"), F.when(F.length(b) > 0, chars(b)).otherwise(F.array().cast("array<string>")).alias("y")))
    return F.get(F.transform(pieces, lambda p: of(p["x"], p["y"])), F.lit(0))


def _change(d0: Column, hp: Column, hn: Column, j: Column, m: Column, most: int) -> Column:
    """How the followed cell grows: along the lowest diagonal, then along the last row."""
    bit = lambda word, k: F.call_function("shiftright", word, k).bitwiseAND(F.lit(1).cast("long")).cast("int")
    row = F.lit(2 * most - 1) - (j - (m - most))
    return F.when(j < m - most, 1 - bit(d0, F.lit(2 * most))).otherwise(bit(hp, row) - bit(hn, row))


def line_links(docs: DataFrame, repeated: DataFrame, text: str, edits: int, least: int) -> DataFrame:
    """All pairs of different lines within ``edits`` edits, by hash: ``h`` and the smaller ``s``, once each.

    Lines of under ``least`` characters are left out. Of two lines that share a key, one is looked
    up by its own segment. Pairs whose signatures differ in more bits than ``edits`` edits can flip
    are never made. A key of many lines is dealt out, so that no task gets all its pairs.
    """
    every = lines_of(docs, text, []).select("h", "line").withColumn("_n", F.length("line")).where(F.col("_n") >= least)
    split = marked(every, bitmap(repeated))
    once = split.where("not _hit").select("h", "line", "_n").unionByName(split.where("_hit").groupBy("h", "_n").agg(F.first("line").alias("line")))
    entries = table(keyed(once, edits))
    ways = F.ceil(F.count("*") / MEMBERS).cast("int").alias("ways")
    shared = cut(entries.groupBy("key").agg(F.min("h").alias("lead"), F.max("h").alias("top"), F.max("own").alias("own"), ways).where("lead < top and own").select("key", "ways"))
    met = marked(entries, bitmap(shared, "key"), "key").where("_hit").select("h", "key", "own")
    met = cut(met.join(shared, "key").groupBy("h", "key", "ways").agg(F.max("own").alias("own")))
    found = marked(every, bitmap(met.select("h"))).where("_hit").groupBy("h").agg(F.first("line").alias("line"))
    texts = cut(found.withColumn("sign", signature(F.col("line"))))
    signed = cut(met.join(texts.select("h", "sign"), "h"))
    owners = signed.where("own").select(F.col("h").alias("s"), "key", F.col("sign").alias("s_sign"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    others = signed.select("h", F.col("key").alias("_k"), "own", "sign", F.pmod(F.xxhash64("h"), F.col("ways")).cast("int").alias("_way"))
    once_each = (F.col("s") != F.col("h")) & (~F.col("own") | (F.col("s") < F.col("h")))
    pairs = owners.join(others, (F.col("key") == F.col("_k")) & (F.col("way") == F.col("_way")) & once_each & alike(F.col("sign"), F.col("s_sign"), edits))
    pairs = pairs.select(F.greatest("h", "s").alias("h"), F.least("h", "s").alias("s")).distinct()
    sides = spread_join(pairs, texts.select("h", F.col("line").alias("_x")), "h", "inner", F.col("s"))
    sides = spread_join(sides, texts.select(F.col("h").alias("s"), F.col("line").alias("_y")), "s", "inner", F.col("h"))
    return sides.where(edit_distance(F.col("_x"), F.col("_y"), edits) <= edits).select("h", "s")


def near_lines(docs: DataFrame, repeated: DataFrame, text: str, edits: int, least: int) -> DataFrame:
    """Hashes ``h`` of lines with a link, ``near``, whether to one of a smaller hash, and the number of ``links``."""
    links = table(line_links(docs, repeated, text, edits, least))
    ends = links.select("h", F.lit(True).alias("near")).unionByName(links.select(F.col("s").alias("h"), F.lit(False).alias("near")))
    return cut(ends.groupBy("h").agg(F.max("near").alias("near"), F.count("*").alias("links")))


def line_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", edits: int = 2, least: int = 40) -> DataFrame:
    """Each document's lines that repeat an earlier one, exactly or nearly.

    A line goes if an equal line came before, by id (nulls first), text hash and
    line number; all occurrences of a line go if a different line within ``edits``
    edits (characters) has a smaller hash (XXH64, seed 42, signed). Lines without a word never go, lines of under ``least`` characters only for
    an equal one. Returns ``id_col``, ``_hash`` (of the text), ``n_lines`` (with a
    word), ``n_exact``, ``n_near``, ``n_links`` and ``dropped``, the 0-based numbers of the
    lines that go. ``n_links`` sums, over the document's lines, how many different lines of the table
    are within ``edits`` edits; copies of a line count as one, and no link is left out.

    A null or empty text has no lines. Rows equal in id and text are one
    document that is listed as often. An empty table gives an empty result.
    """
    known = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"), F.col(text).alias("_t"))
    rows = table(lines_of(known, "_t", [id_col, "_hash"]).select(id_col, "_hash", "no", "h"))
    kinds = table(rows.groupBy("h").agg(F.min(F.struct(id_col, "_hash", "no")).alias("first"), F.count("*").alias("n")))
    linked = near_lines(known.select("_t"), kinds.where("n > 1").select("h"), "_t", edits, least)
    judged = kinds.where("n > 1").join(linked, "h", "full").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"))
    met = spread_join(rows, judged, "h", "inner", F.col("no"))
    # a line that is there once has no ``first``
    copy = ~F.col("near") & F.coalesce(F.struct(F.col(id_col), "_hash", "no") != F.col("first"), F.lit(False))
    told = met.select(id_col, "_hash", "no", "near", copy.alias("copy"), "links").where("near or copy or links > 0").distinct()
    gone = F.when(F.col("near") | F.col("copy"), F.col("no"))
    by_doc = told.groupBy(F.col(id_col).alias("_id"), F.col("_hash").alias("_h")).agg(F.array_sort(F.collect_list(gone)).alias("dropped"), F.sum(F.col("near").cast("long")).alias("n_near"), F.sum(F.col("copy").cast("long")).alias("n_exact"), F.sum("links").alias("n_links"))
    counts = known.select(id_col, "_hash", F.size(F.filter(F.split(F.coalesce("_t", F.lit("")), "\n"), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"))
    joined = counts.join(by_doc, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select(id_col, "_hash", "n_lines", zero("n_exact"), zero("n_near"), zero("n_links"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def remove_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", edits: int = 2, least: int = 40) -> DataFrame:
    """``docs`` with the lines of :func:`line_duplicates` taken out of the texts; nulls stay null."""
    found = line_duplicates(docs, text, id_col, edits, least).where(F.size("dropped") > 0).select(F.col(id_col).alias("_id"), F.col("_hash").alias("_h"), "dropped").distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), F.col(text).alias("_t"))
    joined = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("_t", F.lit(""))) == F.col("_h")), "left")
    kept = F.array_join(F.filter(F.split("_t", "\n"), lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    return joined.withColumn("_t", F.when(F.col("dropped").isNull(), F.col("_t")).otherwise(kept)).select(*[F.col("_t").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
