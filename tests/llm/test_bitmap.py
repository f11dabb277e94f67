"""How a bitmap of hashes comes to the driver."""

import os

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from irforge.llm.base import BITMAP, PAGE, Bitmap


def test_a_bitmap_comes_in_small_pieces(spark, monkeypatch):
    """No task returns more than a small part of the pages, so the driver never gets 16 MB as one result."""
    made = []
    whole = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a: made.append(whole(*a)) or made[-1])
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bitmap = Bitmap(rows, "h")
    h = np.array([r.h for r in rows.collect()], dtype=np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(20_000, 40_000).select(F.xxhash64("id").alias("h")).collect()], dtype=np.int64).view(np.uint64)
    assert bitmap.has(h).all() and bitmap.has(other).mean() < 0.01
    pages = made[0].groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in pages) == 1 << (BITMAP - 6 - PAGE)
    assert max(r["count"] for r in pages) <= 32  # 1 MB
    bitmap.destroy()


def test_an_empty_and_a_small_bitmap(spark):
    nothing = Bitmap(spark.range(0).select(F.col("id").alias("h")), "h")
    assert not nothing.has(np.array([0, 1, 1 << 63], dtype=np.uint64)).any()
    small = Bitmap(spark.createDataFrame([(5 << 50,), (-1,)], "h long"), "h", bits=18)
    assert small.has(np.array([5 << 50, (1 << 64) - 1], dtype=np.uint64)).all() and not small.has(np.array([1 << 62], dtype=np.uint64)).any()


def test_a_bitmap_with_few_marks_is_small_at_the_driver(spark, monkeypatch):
    """20,000 marks lie on all 512 pages: 16 MB came to the driver and left it, whatever the pages held."""
    made = []
    whole = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a: made.append(whole(*a)) or made[-1])
    bitmap = Bitmap(spark.range(20_000).select(F.xxhash64("id").alias("h")), "h")
    assert made[0].agg(F.sum(F.octet_length("bits"))).first()[0] < 1 << 20
    assert os.path.getsize(bitmap.sent._path) < 1 << 20
    bitmap.destroy()
