"""Filters come to the driver as bytes, whatever their size."""

import numpy as np
from pyspark.sql import functions as F

from feedweave.llm import common


def test_filter_is_made_of_blocks_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BLOCK", 1 << 6)
    monkeypatch.delattr(type(spark.range(0)), "toPandas")  # whole tables of words
    for n in (0, 3, 5000):
        hashes = spark.range(n).select(F.xxhash64("id").alias("h"))
        made = common.Filter(hashes, "h")
        want = np.zeros(len(made.words), np.uint64)
        for r in hashes.collect():
            at = (r.h & (1 << 64) - 1) >> 64 - made.bits
            want[at >> 6] |= np.uint64(1 << (at & 63))
        assert (made.words == want).all() and 1 << made.bits >= 16 * n
