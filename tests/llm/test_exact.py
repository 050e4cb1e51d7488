import hashlib
import os
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedweave.llm.exact import exact_dedup


def write(folder, files, kind=pa.int64()):
    os.makedirs(folder, exist_ok=True)
    for name, rows in files.items():
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        n = len(rows)
        pq.write_table(pa.table({"doc_id": pa.array(ids, kind), "text": pa.array(texts, pa.string()), "digest": pa.array(["x"] * n, pa.string()), "n": pa.array([1] * n, pa.int64()), "keep": pa.array(["y"] * n, pa.string())}), f"{folder}/{name}.parquet", row_group_size=50)


def brute(files):
    groups = defaultdict(list)
    for rows in files.values():
        for i, t in rows:
            groups[t or ""].append(i)
    top = lambda ids: max(ids, key=lambda i: (i is not None, i))
    return sorted(((i, top(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str)


def data():
    a = [(i, f"text {i % 40}" if i % 3 else "hot") for i in range(600)]
    b = [(i, f"text {i % 70}") for i in range(600, 800)] + [(800, None), (801, ""), (802, "é" * 300_000), (803, "é" * 300_000), (804, "é" * 299_999), (805, "Hot"), (806, "hot ")]
    return {"a": a, "b": b, "c": [(3000, "hot"), (2999, "only here")]}


def rows_of(found):
    got = found.collect()
    assert all(sum(r["kept"] for r in got if r["text_sha256"] == h) == 1 for h in {r["text_sha256"] for r in got})
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str), got


@pytest.mark.parametrize("files", [1, 100])
def test_groups_are_those_of_brute_force(spark, tmp_path, files):
    write(tmp_path / "docs", data())
    found, got = rows_of(exact_dedup(spark, str(tmp_path / "docs"), files=files))
    assert found == brute(data())
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark, tmp_path):
    write(tmp_path / "docs", data())
    weak = lambda body: F.pmod(F.crc32(body), F.lit(7)).cast("string").cast("binary")
    assert rows_of(exact_dedup(spark, str(tmp_path / "docs"), digest=weak))[0] == brute(data())


def test_the_state_goes_on_with_new_files(spark, tmp_path):
    docs, folder = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    write(docs, {"a": data()["a"]})
    assert rows_of(exact_dedup(spark, docs, folder))[0] == brute({"a": data()["a"]})
    write(docs, {k: data()[k] for k in "bc"})
    assert rows_of(exact_dedup(spark, docs, folder))[0] == brute(data())
    first = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/groups")
    assert first.where(F.col("digest") == F.unhex(F.sha2(F.lit("hot"), 256))).count() == 2  # one version a run
    assert rows_of(exact_dedup(spark, docs, folder))[0] == brute(data())


def test_null_and_repeated_ids_string_ids_one_file_and_empty_tables(spark, tmp_path):
    odd = {"a": [(None, "x"), (1, "x"), (None, "y"), (None, "y"), (5, "z"), (5, "z")]}
    write(tmp_path / "odd", odd)
    assert rows_of(exact_dedup(spark, str(tmp_path / "odd" / "a.parquet")))[0] == brute(odd)
    named = {"a": [("b", "x"), ("a", "x"), ("c", "")]}
    write(tmp_path / "named", named, pa.string())
    assert rows_of(exact_dedup(spark, str(tmp_path / "named")))[0] == brute(named)
    write(tmp_path / "none", {"a": []})
    assert exact_dedup(spark, str(tmp_path / "none")).count() == 0
