"""K selection, features and the replay at size: rows that tasks make or move, and how often the replay runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from irforge.operators import clusters as C
from irforge.operators import joint_kmeans as joint
from irforge.operators import lexical as lex
from irforge.operators import similarity as sim
from irforge.plans import policy_plans as pp
from irforge.plans import selection


def _clustered(spark, n=240, k=50):
    rng = np.random.default_rng(9)
    x, cid = rng.normal(size=(n, 5)), rng.integers(0, k, n)
    cid[:90] = 3                               # one cluster over several blocks
    cid[90:93] = [101, 102, 103]               # singletons
    x[4] = x[5]
    rows = [(f"{i:03d}", v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), cid))] + [("none", [9.0] * 5, None)]
    return x, cid, spark.createDataFrame(rows, "docid string, vec array<double>, cid int").repartition(4)


@pytest.mark.parametrize("sent_out", [True, False])
def test_cluster_distances_equal_brute_force(spark, monkeypatch, sent_out):
    x, cid, df = _clustered(spark)
    if not sent_out:
        monkeypatch.setattr(sim, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(sim, "MERGE_ROWS", 100)
    got = {r["lid"]: r for r in sim.cluster_distances(df, block_rows=32).collect()}
    assert len(got) == len(x)                  # a row a document, not one for each cluster
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i in range(len(x)):
        others = [j for j in range(len(x)) if cid[j] == cid[i] and j != i]
        b = min(dist[i, cid == c].mean() for c in set(cid.tolist()) - {cid[i]})
        r = got[f"{i:03d}"]
        assert r["lcid"] == cid[i] and abs(r["b"] - b) < 1e-6
        assert (r["a"] is None) if not others else abs(r["a"] - dist[i, others].mean()) < 1e-6
        values.append(0.0 if not others else (b - r["a"]) / max(r["a"], b))
    assert abs(C.silhouette(df).first()[0] - np.mean(values)) < 1e-6


def test_sample_of_k_selection_is_read_by_several_tasks(spark, monkeypatch):
    _, _, df = _clustered(spark)
    files = []
    whole = joint.fit
    monkeypatch.setattr(joint, "fit", lambda d, *a, **kw: files.append(len(d.inputFiles())) or whole(d, *a, **kw))
    C.auto_select_k(df.where("cid IS NOT NULL"), n_init=2)
    assert files[0] > 1


def test_centres_go_in_several_passes(spark, monkeypatch):
    _, _, df = _clustered(spark)
    specs = [(3, 0), (5, 0), (9, 1)]
    want = joint.fit(df, specs, 4)
    monkeypatch.setattr(joint, "CENTER_BYTES", 250)
    for a, b in zip(want, joint.fit(df, specs, 4)):
        assert np.allclose(a.centers, b.centers) and a.iterations == b.iterations and abs(a.cost - b.cost) < 1e-9


def test_uniform_sample_is_the_first_by_hash(spark):
    _, _, df = _clustered(spark)
    want = df.orderBy(F.xxhash64(F.lit(7), "docid"), "docid").limit(60)
    got = C.uniform_sample(df, 60, 7)
    assert got.columns == df.columns and {r[0] for r in got.collect()} == {r[0] for r in want.collect()}
    assert C.uniform_sample(df, 999, 7).count() == df.count()


def test_density_moves_one_row_a_document(spark):
    docs = spark.createDataFrame([("a", "red green red"), ("b", "green blue"), ("c", ""), ("d", "blue blue sky over red")], "docid string, doctext string")
    density = lex.tfidf_density(docs)
    want = {r["docid"]: r["density"] for r in lex.tfidf_density(docs, weights=lex.tfidf(docs)).collect()}
    assert {r["docid"]: round(r["density"], 9) for r in density.collect()} == {d: round(v, 9) for d, v in want.items()}
    plan = density._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_replay_of_best_candidate_runs_once(spark, monkeypatch):
    runs = []
    whole = pp.steps
    monkeypatch.setattr(pp, "steps", lambda *a, **kw: runs.append(1) or whole(*a, **kw))
    assert selection.best_candidate(spark, "/root/testdata/sf0.001").count() > 0
    assert len(runs) == 1
