"""Rewards on corpora with equal vectors, one cluster and long duplicate chains; similarity plans."""

import math

import numpy as np
import pytest

from irforge.operators import clusters as C
from irforge.operators import rewards as RW
from irforge.operators import similarity as sim


def unit(v):
    v = np.asarray(v, dtype=float)
    return [float(x) for x in v / np.linalg.norm(v)]


def corpus(spark, vecs, cids=None):
    return spark.createDataFrame([(f"d{i:03d}", v, 0 if cids is None else cids[i]) for i, v in enumerate(vecs)], "docid string, vec array<double>, cid int")


@pytest.mark.parametrize("small_side_bytes", [32 << 20, 0])
def test_rank_among_equal_vectors_is_the_place_by_id(spark, monkeypatch, small_side_bytes):
    monkeypatch.setattr(sim, "BROADCAST_BYTES", small_side_bytes)
    rng = np.random.default_rng(1)
    for _ in range(2):
        v, q = unit(rng.normal(size=64)), unit(rng.normal(size=64))
        c = corpus(spark, [v] * 40)
        steps = spark.createDataFrame([(i, 0, f"d{p:03d}", q) for i, p in enumerate((0, 20, 39))], "step bigint, cid int, docid string, qvec array<double>")
        got = {r.step: (r["rank"], r.r1) for r in RW.rank_reward(steps, c).collect()}
        assert {s: x[0] for s, x in got.items()} == {0: 1, 1: 21, 2: 40}
        assert got[1][1] == pytest.approx(math.exp(-20 / 18.0))


def test_one_cluster_keeps_its_steps(spark):
    c = corpus(spark, [unit([1, 0]), unit([1, 1]), unit([0, 1])])
    steps = spark.createDataFrame([(1, 0, "d000", unit([1, 0.2])), (2, 0, "d002", unit([0.1, 1]))], "step bigint, cid int, docid string, qvec array<double>")
    near = C.nearest_cluster(C.cluster_means(c)).select("cid", "near_cid")
    got = {r.step: r for r in RW.discriminative_reward(steps, c, near).collect()}
    assert set(got) == {1, 2}
    for step, doc, q in ((1, [1, 0], unit([1, 0.2])), (2, [0, 1], unit([0.1, 1]))):
        own = float(np.dot(q, unit(doc)))
        others = [float(np.dot(q, unit(v))) for v in ([1, 0], [1, 1], [0, 1]) if v != doc]
        assert got[step].cos_same == pytest.approx(max(others))
        assert got[step].cos_near == pytest.approx(max(*others, own))  # the pool of the own cluster, source included


def test_nearest_cluster_ties_by_number(spark):
    centers = spark.createDataFrame([(9, unit([1, 1])), (10, unit([1, 1])), (2, unit([1, 0]))], "cid int, center array<double>")
    got = {r.cid: r.near_cid for r in C.nearest_cluster(centers).collect()}
    assert got == {2: 9, 9: 10, 10: 9}


def test_every_question_of_a_long_chain_is_decided(spark):
    # neighbours in the chain are near, all others are far: accept, reject, accept, ...
    step = 0.35
    vecs = [[math.cos(step * i), math.sin(step * i)] for i in range(16)]
    cands = spark.createDataFrame([(f"c{i}", i, v) for i, v in enumerate(vecs)], "cid_key string, seq int, qvec array<double>")
    got = {r.cid_key: r.accepted for r in RW.semantic_dedup(cands, math.cos(step) - 1e-6).collect()}
    assert got == {f"c{i}": i % 2 == 0 for i in range(16)}


def test_k_grid_of_large_collections():
    for n in (100, 10**5, 10**8):
        ks = C.candidate_k_grid(n)
        assert max(8, int(math.sqrt(n))) in ks and ks == sorted(set(ks)) and max(ks) < n
    assert len(C.candidate_k_grid(10**8)) == 5


@pytest.mark.parametrize("small_side_bytes", [32 << 20, 0])
def test_topk_with_equal_vectors(spark, monkeypatch, small_side_bytes):
    monkeypatch.setattr(sim, "BROADCAST_BYTES", small_side_bytes)
    c = corpus(spark, [unit([1, 2, 3])] * 300 + [unit([3, 2, 1])] * 5)
    q = spark.createDataFrame([("q", unit([1, 2, 3]))], "qid string, vec array<double>")
    raw = sim.block_join(q, c, "topk", k=10, left_id="qid", left_vec="vec")
    assert raw.count() <= 10 * sim.MIN_BLOCKS ** 2  # k rows of each block pair at most
    got = [(r.rid, r["rank"]) for r in sim.topk(q, c, 10, left_id="qid", left_vec="vec").orderBy("rank").collect()]
    assert got == [(f"d{i:03d}", i + 1) for i in range(10)]


def test_corpus_vectors_are_not_shuffled_for_a_small_query_side(spark):
    c = corpus(spark, [unit([1, i]) for i in range(50)])
    q = spark.createDataFrame([("q", unit([1, 2]))], "qid string, vec array<double>")
    plan = sim.block_join(q, c, "topk", k=3, left_id="qid", left_vec="vec")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan


def test_running_quantile_equals_numpy_and_is_linear_logarithmic():
    import random
    import time
    from irforge.operators.rewards import RunningQuantile
    rng = random.Random(3)
    for q in (0.0, 0.5, 0.9, 1.0):
        seen, values = RunningQuantile(q), []
        for _ in range(300):
            v = rng.choice([rng.random(), 0.25, -1.0])
            seen.add(v)
            values.append(v)
            assert abs(seen.value() - np.quantile(values, q)) < 1e-12
    seen, began = RunningQuantile(0.9), time.process_time()
    for _ in range(100_000):
        seen.add(rng.random())
        seen.value()
    assert time.process_time() - began < 10
