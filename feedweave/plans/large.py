"""The plan that lexes large documents by as many tasks as they have pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from feedweave.options import Options
from feedweave.sources import pieces as P
from feedweave.sources.lexer import Names, lexed_ddl, lexing

_PIECE = "_no int, _last boolean, _encoding string, _prolog string, _text string"


def _composed(marks: DataFrame) -> DataFrame:
    """``_doc, _no, _group, _end``: the piece that each piece belongs to, and the document's last state.

    A document's functions are folded in order: they are as many numbers as states,
    for at most as many pieces as fit into the largest document. Copies of a document have the same ones.
    """
    ordered = marks.groupBy("_doc").agg(F.array_sort(F.collect_set(F.struct("_no", "_f"))).alias("_all"))
    start = F.struct(F.lit(P.TEXT).alias("state"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("groups"))

    def step(acc, x):
        group = F.when(acc["state"] == P.TEXT, x["_no"]).otherwise(acc["group"])
        return F.struct(F.get(x["_f"], acc["state"]).alias("state"), group.alias("group"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    folded = ordered.select("_doc", F.aggregate("_all", start, step).alias("_s"))
    return folded.select("_doc", F.col("_s.state").alias("_end"), F.posexplode("_s.groups").alias("_no", "_group"))


def lex_large(docs: DataFrame, content: str, options: Options, names: Names, size: int) -> DataFrame:
    """As lexing, with ``_first``: a row for each piece, whose entries follow as many others.

    Documents of up to ``size`` bytes, JSON and unknown formats are one piece. So is,
    so that results never differ, one where cutting cannot be proved right: a tag never ends, an entry
    stands in another element, or elements of the feed follow entries.

    The plan reads ``docs`` several times, whose rows may come in another order each time. So a document is
    known by its digest: copies share what depends on the content only, and each keeps its own columns.
    """
    kept = [c for c in docs.columns if c != content]
    numbered = docs.select(F.struct(*kept, F.lit(0).alias("_")).alias("_own"), F.col(content).alias("_content"), F.sha2(content, 256).alias("_doc"))
    own = ["_own", "_doc"]
    keep = StructType([numbered.schema[n] for n in own])
    lexed = StructType.fromDDL(lexed_ddl(names)).fields
    cut_schema = StructType([*keep.fields, *StructType.fromDDL(f"{_PIECE}, _content binary").fields])
    cut = numbered.mapInArrow(P.cutting(options, own, "_content", size), cut_schema)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(*own, "_content").mapInArrow(lexing(options, to_arrow_schema(keep), "_content", names), StructType([*keep.fields, *lexed])).withColumn("_first", F.lit(0).cast("long"))

    # by number: text shrinks in a shuffle, so its size there would give few tasks. The conditions are those that joins would
    # add, so that all that reads the pieces has the same plan below the shuffle, which then is made once
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut.where("_text is not null and _doc is not null and _no is not null").drop("_content").repartition(tasks, "_doc", "_no")
    composed = _composed(pieces.mapInArrow(P.transfers, "_doc string, _no int, _f array<int>"))
    members = composed.withColumn("_members", F.count("*").over(Window.partitionBy("_doc", "_group")))
    # the planner cannot know how much text there is: never broadcast nor sort it
    placed = pieces.join(members.hint("shuffle_hash"), ["_doc", "_no"])
    columns = [*own, "_no", "_last", "_encoding", "_prolog", "_text"]
    alone = placed.where("_members = 1").select(*columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_no", "_text"))), lambda x: x["_text"]), "")
    # a row for each copy of the document, of its first piece
    owners = F.collect_list(F.when(F.col("_no") == F.col("_group"), F.struct("_own"))).alias("_owners")
    joined = placed.where("_members > 1").groupBy("_doc", "_group").agg(owners, *[F.first(n).alias(n) for n in ("_encoding", "_prolog")], F.max("_last").alias("_last"), body.alias("_text"))
    joined = joined.withColumnRenamed("_group", "_no").withColumn("_own", F.explode("_owners._own")).select(*columns)
    parts = alone.unionByName(joined)

    # number of entries and verdict in one value: both are wanted of each piece, which is judged once
    judged = parts.mapInArrow(P.judging(options), "_doc string, _no int, _judged array<int>").groupBy("_doc", "_no").agg(F.first("_judged").alias("_judged"))
    ends = composed.groupBy("_doc").agg(F.first("_end").alias("_end"))
    own_doc = Window.partitionBy("_doc")
    before = own_doc.orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("_judged")[0]).over(before), F.lit(0)).alias("_first")
    told = judged.select("_doc", "_no", first, F.min(F.col("_judged")[1]).over(own_doc).alias("_ok")).join(ends, "_doc")
    told = told.withColumn("_fine", (F.col("_ok") == 1) & ~F.col("_end").isin(*P.OPEN_TAG))
    offsets, unfit = told.where("_fine").select("_doc", "_no", "_first"), told.where("not _fine").select(F.col("_doc").alias("_unfit")).distinct()
    # each by itself, as they are dealt by piece already and their union is not
    ready = [x.join(offsets.hint("shuffle_hash"), ["_doc", "_no"]) for x in (alone, joined)]
    split = ready[0].unionByName(ready[1]).mapInArrow(P.lexing_pieces(options, [*own, "_first"], names), StructType([*keep.fields, StructField("_first", LongType()), *lexed]))
    # a digest for a document of at least ``size`` bytes, against text that is neither shuffled nor filtered for this
    again = whole(numbered.join(F.broadcast(unfit), numbered["_doc"].eqNullSafe(unfit["_unfit"]), "left_semi"))
    found = whole(cut.where("_text is null")).unionByName(split).unionByName(again)
    return found.select(*[F.col(f"_own.`{c}`").alias(c) for c in kept], "_first", *[f.name for f in lexed])
