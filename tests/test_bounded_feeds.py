"""Queries whose feeds must not grow with their table, nor lose entries where they do."""

import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from feedweave import queries as Q
from feedweave.plans.parse import lex
from feedweave.plans.tables import create_entry_view


def test_feeds_of_many_orders_keep_all_entries(spark, tmp_path):
    spark.range(10_050).select(F.col("id").alias("o_orderkey"), (F.col("id") * 150).alias("o_custkey"), F.lit("LOW").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    assert Q.timed_entries(spark, str(tmp_path)).count() == 10_050
    far = spark.range(3).select((F.col("id") * 1_000_000).alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit("LOW").alias("o_orderpriority"))
    far.write.parquet(f"{tmp_path}/far/orders.parquet")
    assert Q.timed_feeds(spark, f"{tmp_path}/far").count() == 3


def test_feeds_of_many_parts_keep_all_entries(spark, tmp_path):
    spark.range(10_050).select(F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), F.lit("Brand").alias("p_brand"), F.lit("b").alias("p_type"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    assert Q.rdf_entries(spark, str(tmp_path)).count() == 10_050


def test_lines_of_a_block_are_dealt_over_feeds(spark, tmp_path):
    lines = spark.range(600).select((F.col("id") * 997 % 260_000).alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit("R").alias("l_returnflag"), F.timestamp_seconds(F.col("id")).alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert Q.lineitem_feed(spark, str(tmp_path)).where("block = 0").count() == 100
    got = Q.large_feed_entries(spark, str(tmp_path)).select("block", "entry_idx", "id").collect()
    want = duckdb.sql(f"select block, entry_idx, id from ({Q.ORACLE_SQL['large_feed_entries'].replace('from lineitem', f"from '{tmp_path}/lineitem.parquet/*.parquet'")})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_view_of_entries_has_no_join(spark):
    docs = [(k, f"<rss><channel><item><title>{k}</title></item><item><title>b</title></item></channel></rss>".encode()) for k in (1, 2, 2)]
    spark.createDataFrame(docs, "k int, content binary").createOrReplaceTempView("some_docs")
    create_entry_view(spark, "some_entries", "some_docs", entry_fields=("title",))
    got = spark.sql("select k, entry_idx, title from some_entries")
    assert sorted(map(tuple, got.collect())) == sorted((k, i, t) for k in (1, 2, 2) for i, t in enumerate((str(k), "b")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_fragments_of_few_input_tasks_are_dealt_out(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = Q.sanitized_fragments(spark, str(tmp_path))
    assert got.count() == 100 * len(Q.FRAGMENTS) and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_what_goes_to_python_at_once_is_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(60).repartition(1).select("id", F.repeat(F.lit("x"), F.lit(1 << 20)).cast("binary").alias("content"))
    lex(docs)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) >= 60 << 20 and max(r.n for r in sizes) <= 16 << 20


def joins(df):
    return re.findall(r"(\w*Join) \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_parsed_entries_are_not_broadcast(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("o_orderkey"), (F.col("id") * 150 % 1000).alias("o_custkey"), F.lit("LOW").alias("o_orderpriority"), F.lit(1.5).alias("o_totalprice"), F.timestamp_seconds(F.col("id")).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2000).select(F.col("id").alias("event_id"), (F.col("id") % 3 * 50).alias("user_id"), F.lit("view").alias("event_type"), F.timestamp_seconds(F.col("id") * 40 + 1704067200).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1000).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), F.lit(0).alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1).select(F.lit(0).alias("r_regionkey"), F.lit("R").alias("r_name")).write.parquet(f"{tmp_path}/region.parquet")
    near, nations = Q.entries_near_events(spark, str(tmp_path)), Q.entries_by_nation(spark, str(tmp_path))
    assert joins(near) == [("SortMergeJoin", "user_id")]
    assert ("SortMergeJoin", "o_custkey") in joins(nations)
    duck = duckdb.connect()
    duck.execute("set timezone = 'UTC'")
    for name in ("orders", "events", "customer", "nation", "region"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for got, name in ((near, "entries_near_events"), (nations, "entries_by_nation")):
        want = sorted(duck.execute(Q.ORACLE_SQL[name]).fetchall())
        assert want and sorted(map(tuple, got.collect())) == want
