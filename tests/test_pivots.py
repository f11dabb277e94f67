"""Threshold joins under pivot bounds: equal to brute force, and most pairs of grouped vectors are never compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from irforge.operators import pivots as pv
from irforge.operators import similarity as sim


def _grouped(n_groups=30, each=20, dims=12, spread=0.05):
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 1, (n_groups, 1, dims)) + rng.normal(0, spread, (n_groups, each, dims))).reshape(-1, dims)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[each:3 * each] = x[0]                   # a hot group of equal vectors
    x[5] = 0.0
    x[7] *= 3.0                               # not of unit length
    return x


def _frame(spark, x):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(x.tolist())], "docid string, vec array<double>").repartition(5)


@pytest.mark.parametrize("scan", [True, False])
@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.5, 0.9])
def test_counts_and_edges_equal_brute_force(spark, monkeypatch, scan, threshold):
    x = _grouped(n_groups=8, each=10)
    d = _frame(spark, x)
    monkeypatch.setattr(sim, "SPARSE", 1.0)   # group by group whatever it saves
    if not scan:
        monkeypatch.setattr(sim, "BROADCAST_BYTES", 0)
    above = x @ x.T > threshold
    np.fill_diagonal(above, False)
    got = {r["lid"]: r["cnt"] for r in sim.threshold_count(d, d, threshold, exclude_self=True, block_rows=16).collect()}
    assert [got.get(str(i), 0) for i in range(len(x))] == above.sum(axis=1).tolist()
    edges = sorted((int(r["lid"]), int(r["rid"])) for r in sim.threshold_edges(d, d, threshold, exclude_self=True, block_rows=16).collect())
    assert edges == [tuple(e) for e in np.argwhere(above).tolist()]


def test_other_side_and_order_columns(spark):
    x = _grouped(n_groups=6, each=10)
    d = _frame(spark, x).withColumn("seq", F.col("docid").cast("long"))
    q = d.where("seq % 7 = 0")
    s = x @ x.T
    asked = range(0, len(x), 7)
    for left, right, pairs in ((q, d, [(i, j) for i in asked for j in range(len(x))]), (d, q, [(i, j) for i in range(len(x)) for j in asked])):
        rows = sim.block_join(left, right, "edges_ge", threshold=0.8, left_cols={"lorder": "seq"}, right_cols={"rorder": "seq"}).collect()
        assert sorted((int(r["lid"]), int(r["rid"])) for r in rows) == [p for p in pairs if s[p] >= 0.8 and p[1] < p[0]]


def test_grouped_vectors_are_mostly_skipped(spark):
    x = _grouped()
    x[20:60] += 1.0                           # without the hot group
    d = _frame(spark, x)
    assert pv.skipped_share(d, 0.9, 32) > 0.7
    assert pv.skipped_share(d, -0.5, 32) == 0.0


def test_empty_and_zero_vectors(spark):
    d = _frame(spark, np.zeros((3, 4)))
    assert sim.threshold_edges(d, d, 0.1).count() == 0
    assert sim.threshold_edges(d.limit(0), d, 0.1).count() == 0
