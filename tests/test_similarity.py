"""Blocked similarity kernels against brute force, and layout independence."""

import numpy as np
from pyspark.sql import functions as F

from irforge.operators import similarity as sim


def _frame(spark, X, prefix):
    return spark.createDataFrame([(f"{prefix}{i}", [float(v) for v in x]) for i, x in enumerate(X)], "docid string, vec array<double>")


def test_topk_and_counts_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    Q = rng.normal(size=(37, 8))
    D = rng.normal(size=(101, 8))
    q, d = _frame(spark, Q, "q"), _frame(spark, D, "d")
    S = Q @ D.T
    got = sim.topk(q, d, 5, min_blocks=3).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r["lid"], []).append((r["rank"], r["rid"]))
    for i in range(len(Q)):
        order = sorted(range(len(D)), key=lambda j: (-round(S[i, j], 6), f"d{j}"))[:5]
        assert [rid for _, rid in sorted(by_q[f"q{i}"])] == [f"d{j}" for j in order]
    cnt = {r["lid"]: r["cnt"] for r in sim.threshold_count(d, d, 0.5, exclude_self=True, min_blocks=4).collect()}
    SD = D @ D.T
    for i in range(len(D)):
        want = int(((SD[i] > 0.5) & (np.arange(len(D)) != i)).sum())
        assert cnt.get(f"d{i}", 0) == want


def test_layout_independence(spark):
    rng = np.random.default_rng(1)
    D = rng.normal(size=(64, 6))
    d = _frame(spark, D, "d")
    a = sorted(tuple(r) for r in sim.topk(d, d, 3, min_blocks=1).collect())
    b = sorted(tuple(r) for r in sim.topk(d.repartition(7), d.repartition(3), 3, min_blocks=5).collect())
    assert a == b


def test_ivf_topk_recall(spark):
    from irforge.plans import model_plans
    from irforge.sources import tables as T
    from tests.conftest import SF_CHECK
    corpus = T.unit_embeddings(spark, SF_CHECK).select("docid", "vec")
    queries = T.shifted_unit_embeddings(spark, SF_CHECK, 7, 1).where("cast(docid as long) % 50 = 0")
    exact = {(r.lid, r.rid) for r in sim.topk(queries, corpus, 100, left_vec="qvec", right_vec="vec").collect()}
    found = {(r.qid, r.docid) for r in model_plans.ivf_topk(spark, SF_CHECK).where("cast(qid as long) % 50 = 0").collect()}
    assert len(found & exact) >= 0.9 * len(exact) > 0


def _grouped(spark, n_groups=150, each=40, dims=16):
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 1, (n_groups, 1, dims)) + rng.normal(0, 0.08, (n_groups, each, dims))).reshape(-1, dims)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1::each] = x[::each]  # ties
    docs = spark.createDataFrame([(str(i), v) for i, v in enumerate(x.tolist())], "docid string, vec array<double>").repartition(6)
    queries = spark.createDataFrame([(str(i), v) for i, v in enumerate(x.tolist()) if i % 50 == 0], "qid string, qvec array<double>")
    s = np.round(x[::50] @ x.T, 6)
    exact = {}
    for q, row in zip(range(0, len(x), 50), s):
        exact[str(q)] = [d for _, d in sorted(zip((-row).tolist(), map(str, range(len(x)))))[:20]]
    return docs, queries, exact


def test_ivf_index_grows_and_a_search_reads_few_cells(spark):
    from irforge.operators import ann
    docs, queries, exact = _grouped(spark)
    index = ann.ivf_index(docs)
    n_cells = len(index.cells.centers)
    assert 0.6 * 6000 ** 0.5 < n_cells < 1.5 * 6000 ** 0.5
    sizes = index.table().groupBy("cell").count().toPandas()["count"]
    assert sizes.sum() == 6000 and set(index.table().toPandas()["docid"]) == {str(i) for i in range(6000)}
    nprobe = ann.calibrate(queries, docs, index, 20, 0.95)
    assert nprobe < 0.1 * n_cells
    got = ann.ivf_topk(queries, index, 20, nprobe).collect()
    found = {(r.qid, r.docid) for r in got}
    assert len(found & {(q, d) for q, ds in exact.items() for d in ds}) >= 0.9 * 20 * len(exact) and len(got) == 20 * len(exact)
    plan = index.table([0, 1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_ivf_with_all_cells_is_exact_in_slices(spark, monkeypatch):
    from irforge.operators import ann
    monkeypatch.setattr(ann, "QUERY_BYTES", 4096)
    docs, queries, exact = _grouped(spark, 30, 20)
    index = ann.ivf_index(docs, 9)
    got = {}
    for r in sorted(ann.ivf_topk(queries, index, 20, 99).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.qid, []).append(r.docid)
    assert got == exact


def test_ivf_of_no_documents_or_queries(spark):
    from irforge.operators import ann
    docs, queries, _ = _grouped(spark, 3, 20)
    index = ann.ivf_index(docs, 4)
    assert ann.ivf_topk(queries.limit(0), index, 5, 2).count() == 0
    empty = ann.ivf_index(docs.limit(0))
    assert empty.table().count() == 0
