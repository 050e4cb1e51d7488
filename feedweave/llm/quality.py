"""Quality rules: text statistics and learned decision lists, in SQL functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import GAP, cut, fold, words

SYMBOLS = r"[#*$%&|<>]"
#: What rules may test: shares and means of the counted statistics.
FEATURES = ("symbol_share", "shout_share", "bang_share", "dup_line_share", "repeat_share", "word_length", "line_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the planner puts it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(tokens: Column) -> Column:
    """How many of the words are inside 3-word windows found twice or more.

    A hash finds the windows that may repeat: a window's hash, with its position
    in the low bits, is one number; equal windows are neighbours once a text's
    numbers are sorted. These windows are then compared word by word.
    """
    shift = lambda name, x, bits: F.call_function(name, x, bits)
    one = F.lit(1).cast("long")

    def of(w: Column, bits: Column) -> Column:
        window = lambda x, i: shift("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))
        spans = F.sort_array(F.transform(F.slice(w, F.lit(1), F.size(w) - 2), window))
        return let(spans, lambda s: let(positions(s, bits), lambda p: let(F.sort_array(equal(w, p)), covered)))

    def positions(s: Column, bits: Column) -> Column:
        top = lambda x: shift("shiftright", x, bits)
        same = lambda x, y: F.coalesce(top(x) == top(y), F.lit(False))
        low = lambda x: x.bitwiseAND(shift("shiftleft", one, bits) - 1)
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.transform(twice, low)

    def equal(w: Column, p: Column) -> Column:
        """The positions whose windows really are equal to another's; words hold no space."""
        at = lambda i, k: F.get(w, i.cast("int") + k)
        named = F.sort_array(F.transform(p, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("t"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))
        twice = lambda n: F.filter(n, lambda x, i: same(x, F.get(n, i - 1)) | same(x, F.get(n, i + 1)))
        return let(named, lambda n: F.transform(twice(n), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        """Each position covers three words, less what the next one covers too."""
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")), F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(tokens, lambda w: F.when(F.size(w) >= 3, let(F.ceil(F.log2(F.size(w) + 1)).cast("int"), lambda bits: of(w, bits))))
    return F.coalesce(found, F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of every whole text; null counts as no text."""
    has_word = lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, whole.alias("_t"), words(F.col(text)).alias("_w"), F.filter(F.split(whole, "\n"), has_word).alias("_l"))
    return base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_bangs"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
    )


def features(stats: DataFrame) -> DataFrame:
    """Add :data:`FEATURES` to the statistics; a text without words has zeros."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return stats.withColumns(
        {
            "symbol_share": share("n_symbols", "n_words"),
            "shout_share": share("n_upper", "word_chars"),
            "bang_share": share("n_bangs", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
            "line_words": share("n_words", "n_lines"),
        }
    )


@dataclass(frozen=True)
class Test:
    """One threshold condition."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x >= self.threshold if self.above else x < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Test, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out &= test.column()
    return out


def decision(rules: list[Rule]) -> Column:
    """The first rule that holds, as text, or null: one ordered conditional."""
    if not rules:
        return F.lit(None).cast("string")
    first, *rest = rules
    out = F.when(holds(first), " and ".join(map(str, first)))
    for rule in rest:
        out = out.when(holds(rule), " and ".join(map(str, rule)))
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_tests: int = 3, cuts: int = 24, precision: float = 0.95, support: int = 4) -> list[Rule]:
    """Sequential covering over rows with :data:`FEATURES`, ``bad`` and ``pruning``.

    A rule is grown test by test on the growing rows, taking the threshold with
    the best information gain, until it covers no good row or has ``max_tests``;
    it is pruned to the prefix that is best on the pruning rows, and kept if its
    precision on all labelled rows left reaches ``precision`` with ``support``
    bad rows. Rows it covers are taken out, and the next rule is learned. Only
    counts by feature and threshold reach the driver. No bad rows: no rules.
    """
    bad = labelled.where("bad")
    points = bad.select(*[F.percentile_approx(f, [i / cuts for i in range(cuts + 1)], 1000).alias(f) for f in FEATURES]).first()
    every = labelled.select(*[F.percentile_approx(f, [i / cuts for i in range(cuts + 1)], 1000).alias(f) for f in FEATURES]).first()
    if points[0] is None:
        return []
    edges = {f: sorted({*points[f], *every[f]}) for f in FEATURES}
    place = lambda f: F.size(F.filter(F.array(*map(F.lit, edges[f])), lambda e: e <= F.col(f)))
    rows = cut(labelled.select("bad", "pruning", *FEATURES, *[place(f).alias(f"_{f}") for f in FEATURES]))
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{f}").alias("place")) for f in FEATURES]))
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_tests:
            table = rows.where(left & ~F.col("pruning") & holds(rule)).select("bad", stacked.alias("x")).groupBy("x.feature", "x.place").agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.count("*").alias("n")).collect()
            test = _best(table, edges)
            if test is None:
                break
            rule = (*rule, test)
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        if not prefixes:
            break
        sums = lambda where, name: [F.sum((where & holds(p) & F.col("bad")).cast("int")).alias(f"{name}b{k}") for k, p in enumerate(prefixes)] + [F.sum((where & holds(p)).cast("int")).alias(f"{name}n{k}") for k, p in enumerate(prefixes)]
        got = rows.where(left).agg(*sums(F.col("pruning"), "p"), *sums(F.lit(True), "a")).first()
        worth = lambda k: (2 * (got[f"pb{k}"] or 0) - (got[f"pn{k}"] or 0)) / max(1, got[f"pn{k}"] or 0)
        k = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
        caught, covered = got[f"ab{k}"] or 0, got[f"an{k}"] or 0
        if caught < support or caught < precision * covered:
            k = len(prefixes) - 1
            caught, covered = got[f"ab{k}"] or 0, got[f"an{k}"] or 0
            if caught < support or caught < precision * covered:
                break
        rules.append(prefixes[k])
        left &= ~holds(prefixes[k])
    return rules


def _best(table: list, edges: dict[str, list[float]]) -> Test | None:
    """The test with the highest FOIL gain that leaves out some good row."""
    total = sum(r["n"] for r in table if r["feature"] == FEATURES[0])
    bad = sum(r["bad"] for r in table if r["feature"] == FEATURES[0])
    if not bad or bad == total:
        return None
    best, gain = None, 0.0
    for f in FEATURES:
        at = {r["place"]: r for r in table if r["feature"] == f}
        under_bad = under = 0
        for k, edge in enumerate(edges[f]):
            if k in at:
                under_bad, under = under_bad + at[k]["bad"], under + at[k]["n"]
            for above, b, n in ((True, bad - under_bad, total - under), (False, under_bad, under)):
                if b and n < total:
                    g = b * (log2(b / n) - log2(bad / total))
                    if g > gain + 1e-9:
                        best, gain = Test(f, above, float(edge)), g
    return best


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", most: int = 20_000) -> DataFrame:
    """Features of at most ``most`` labelled rows, chosen by the hash of their id.

    A document with several labels is bad if all of them are 0. Null ids and
    labels are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label) == 0).alias("bad"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text"))
    joined = rows.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_text", "bad", (fold("_doc", 3) == 2).alias("pruning"))
    return cut(features(statistics(joined, "_text", ["bad", "pruning"]))).where(~failed())


def failed(least_words: int = 50) -> Column:
    """Too few words, or too many in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: the id), the statistics, ``base_failed``, ``kept`` and ``rule``.

    Rules are learned from ``labels`` and applied to all rows, where the fixed
    conditions come first. A null or empty text has zeros everywhere and fails.
    Rows with equal or null ids are judged each by its own text. Without labels
    only the fixed conditions hold. An empty table gives an empty result.
    """
    rules = learn(labelled_sample(docs, labels, text, id_col))
    judged = features(statistics(docs, text, keep or [id_col]))
    judged = judged.withColumn("base_failed", failed()).withColumn("rule", F.when(~F.col("base_failed"), decision(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", least_words: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects.

    As :func:`quality` judges, but a short text is not rejected for that alone;
    one without a word is. Rows are judged each by its own text.
    """
    rules = learn(labelled_sample(docs, labels, text, id_col))
    everything = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    judged = features(statistics(docs.select(everything, F.col(text).alias("_text")), "_text", ["_row"]))
    return judged.where(~failed(least_words) & decision(rules).isNull()).select("_row.*")
