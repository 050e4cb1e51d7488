"""Temperature mixing of sources to target weights, in SQL functions."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedweave.llm.common import cut, table, words
from feedweave.llm.sharding import BIN_ROWS, shuffle_key


def _measure(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy, and the largest repetition at a budget of all tokens, by exponent."""
    aggregates = []
    for k, a in enumerate(exponents):
        power = F.pow(F.col("share"), F.lit(a))
        aggregates += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("share")).alias(f"l{k}"), F.max(power / F.col("share")).alias(f"m{k}")]
    got = sources.agg(*aggregates).first()
    return [(log(got[f"z{k}"]) - a * got[f"l{k}"] / got[f"z{k}"], got[f"m{k}"] / got[f"z{k}"]) for k, a in enumerate(exponents)]


def exponent(sources: DataFrame, evenness: float, repeats: float, scale: float = 1.0, digits: int = 6) -> float:
    """The exponent in [0, 1] that shares are raised to.

    1 keeps the shares, 0 makes them equal. Taken is the largest exponent whose
    weights have at least ``evenness`` of the highest possible entropy; if a
    source would then be repeated over ``repeats`` times, the smallest exponent
    that avoids it (or 1). Each step of the bisection is one aggregate over the
    sources, here at the seven exponents of three levels at once.
    """
    goal = evenness * log(max(1, sources.count()))

    def bisect(good_at_low) -> float:
        low, high = 0.0, 1.0
        while high - low > 10 ** -(digits + 2):
            step = (high - low) / 8
            points = [low + k * step for k in range(1, 8)]
            n = 0
            for x in _measure(sources, points):
                if not good_at_low(x):
                    break
                n += 1
            low, high = low + n * step, low + (n + 1) * step
        return round(low, digits)

    at_one, at_zero = _measure(sources, [1.0, 0.0])
    found = 1.0 if at_one[0] >= goal else bisect(lambda x: x[0] >= goal)
    if _measure(sources, [found])[0][1] * scale > repeats:
        found = 1.0 if at_one[1] * scale > repeats else bisect(lambda x: x[1] * scale > repeats)
    return found


def plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", budget: int | None = None, evenness: float = 0.9, repeats: float = 4.0, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The rows' token counts, and per source its weight, budget and cut.

    First table: ``id_col``, ``source``, ``n_tokens`` (words and one end). Second,
    by ``source``: ``tokens``, ``weight``, ``budget``, ``full`` (whole blocks) and
    ``cut``: in the last, partial block, rows with a key up to it are taken.
    """
    rows = cut(docs.select(id_col, source, (F.size(words(F.col(text))) + 1).cast("long").alias("n_tokens")))
    by_source = rows.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("_rows"))
    total, count = (by_source.agg(F.sum("tokens"), F.sum("_rows")).first())
    goal = budget or total or 0
    sources = cut(by_source.withColumn("share", F.col("tokens") / F.lit(float(total or 1))))
    alpha = exponent(sources, evenness, repeats, goal / (total or 1)) if total else 1.0
    z = sources.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    weighted = sources.withColumn("weight", F.pow("share", F.lit(alpha)) / z).withColumn("budget", F.floor(F.col("weight") * goal).cast("long"))
    weighted = table(weighted.select(F.col(source).alias("_source"), "tokens", "weight", "budget", F.expr("budget div tokens").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest")))
    bins = max(1, min(1 << 20, (count or 0) // BIN_ROWS))
    same = F.col(source).eqNullSafe(F.col("_source"))
    keyed = rows.join(weighted.select("_source", "full", "rest"), same).withColumn("key", shuffle_key(id_col, seed, F.col("full"))).withColumn("bin", F.floor(F.col("key") / float(1 << 60) * bins).cast("long"))
    sums = keyed.groupBy("_source", "rest", "bin").agg(F.sum("n_tokens").alias("n"))
    running = F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = table(sums.withColumn("before", running).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select(F.col("_source").alias("_s"), F.col("bin").alias("_b"), "before"))
    inside = keyed.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    by_key = inside.groupBy("_source", "key", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    earlier = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = by_key.withColumn("_e", earlier).where(F.col("_e") < F.col("rest")).groupBy(F.col("_source").alias("_s")).agg(F.max("key").alias("cut"))
    joined = weighted.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return rows, table(joined.select(F.col("_source"), "tokens", "weight", "budget", "full", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut")))


def realise(rows: DataFrame, sources: DataFrame, id_col: str = "doc_id", source: str = "source", seed: int = 11) -> DataFrame:
    """Every row once for each block that takes it, with ``block`` and ``place``.

    A source's blocks are permutations of its rows by ``place``, a seeded hash
    of block and id; the last one is cut at the source's budget.
    """
    s = sources.select("_source", "full", F.col("cut").alias("_cut"))
    key = shuffle_key(id_col, seed, F.col("_block"))
    joined = rows.join(s, F.col(source).eqNullSafe(F.col("_source")))
    blocks = joined.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("_place", key)
    taken = blocks.where((F.col("_block") < F.col("full")) | (F.col("_place") <= F.col("_cut")))
    return taken.select(*rows.columns, F.col("_block").alias("block"), F.col("_place").alias("place"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", budget: int | None = None, evenness: float = 0.9, repeats: float = 4.0, seed: int = 11) -> DataFrame:
    """``docs``, each row as often as the mixture takes it.

    Shares of tokens are raised to an exponent (see :func:`exponent`) and made
    weights that add up to one; a source's budget is its weight of ``budget``
    (default: all tokens). It is met by whole permutations of the source and a
    part of one, up to the row that reaches the budget. Columns are those of
    ``docs``; texts are not shuffled.

    Null is a source of its own. A null or empty text counts one token, its end.
    Null ids hash as the empty text; rows with one id share their place and are
    taken together. An empty table gives an empty result.
    """
    _, sources = plan(docs, text, id_col, source, budget, evenness, repeats, seed)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), F.col(source).alias("_of"))
    return realise(rows, sources, "_doc", "_of", seed).select("_row.*")
