"""Top-k of many rows: equal to brute force by every path, with nothing merged after a task."""

import numpy as np
import pyarrow as pa
import pytest

from irforge.operators import ann
from irforge.operators import similarity as sim
from irforge.operators import topk as tk


def _rows(n=400, dims=8, seed=3, ids=None):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x[30:90] = x[30]                           # ties at the cut
    x[100] = 0.0
    return [(str(i) if ids is None else ids[i], v) for i, v in enumerate(x.tolist())]


def _brute(left, right, k):
    y, names = np.array([v for _, v in right]), [i for i, _ in right]
    found = {}
    for lid, v in left:
        score = np.round((np.array(v) * y).sum(1), 6)
        found.setdefault(lid, []).extend(zip((-score).tolist(), names))
    return {lid: [(r, -s, i + 1) for i, (s, r) in enumerate(sorted(rows)[:k])] for lid, rows in found.items()}


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["lid"], r["rank"])):
        out.setdefault(r.lid, []).append((r.rid, r.score, r["rank"]))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_blocks_equal_brute_force(spark, monkeypatch, small):
    left = _rows(300, seed=4, ids=[str(i % 290) for i in range(300)])  # ten ids come twice
    right = _rows()
    monkeypatch.setattr(tk, "STEP", (16, 64))
    monkeypatch.setattr(tk, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(tk, "MOST_ROWS", 40)
    if not small:
        monkeypatch.setattr(sim, "BROADCAST_BYTES", 20000)
    out = sim.topk(spark.createDataFrame(left, "docid string, vec array<double>").repartition(3), spark.createDataFrame(right, "docid string, vec array<double>").repartition(5), 12)
    assert _got(out) == _brute(left, right, 12)


@pytest.mark.parametrize("small", [True, False])
def test_nothing_is_merged_after_a_task(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(sim, "BROADCAST_BYTES", 20000)
    d = spark.createDataFrame(_rows(), "docid string, vec array<double>")
    plan = sim.topk(d, d, 12)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and ("CartesianProduct" in plan) != small


def test_large_and_non_finite_values(spark):
    right = [("a", [1e30, 0.0]), ("b", [2e30, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0, 1.0]), ("e", [-1e30, 5.0])]
    best = tk.Best(np.array([[1e20, 0.0], [0.0, 1.0]]), 2)
    best.add(np.array([v for _, v in right]), np.arange(5), pa.array([i for i, _ in right]))
    group, score, ids = best.rows()
    assert list(zip(group.tolist(), ids.to_pylist())) == [(0, "b"), (0, "a"), (1, "e"), (1, "d")]


def test_candidates_stay_bounded(spark):
    """All right rows tie: the smallest keys stay, and no more than k of a row are kept."""
    best = tk.Best(np.ones((50, 4)), 5)
    for at in range(0, 40000, 10000):
        key = np.arange(at, at + 10000)[::-1].copy()
        best.add(np.ones((10000, 4)), key, pa.array([f"{i:06d}" for i in key.tolist()]))
        best.settle()
        assert len(best.parts[0][0]) == 250
    assert best.rows()[2].to_pylist() == [f"{i:06d}" for i in range(5)] * 50


def test_many_queries_of_an_index_meet_the_cells_without_a_merge(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).tolist()
    docs = spark.createDataFrame([(str(i), v) for i, v in enumerate(x)], "docid string, vec array<double>").repartition(4)
    left = [(str(i), v) for i, v in enumerate(rng.normal(size=(300, 8)).tolist())]
    queries = spark.createDataFrame(left, "qid string, qvec array<double>")
    index = ann.ivf_index(docs, 9)
    whole = ann.ivf_topk(queries, index, 20, 99)
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    assert _got(whole.toDF("lid", "rid", "score", "rank")) == _brute(left, [(str(i), v) for i, v in enumerate(x)], 20)
    cell = {r.docid: r.cell for r in index.table().collect()}
    near = {q: set(c.tolist()) for (q, _), c in zip(left, index.cells.ranked(np.array([v for _, v in left]))[:, :3])}
    for q, rows in _got(ann.ivf_topk(queries, index, 20, 3).toDF("lid", "rid", "score", "rank")).items():
        own = [(str(i), v) for i, v in enumerate(x) if cell[str(i)] in near[q]]
        assert rows == _brute([left[int(q)]], own, 20)[q]


@pytest.mark.parametrize("scale", [1.0, 1e25])
def test_counts_in_single_precision_are_exact(scale):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([f"{i:03d}" for i in range(700)], dtype=object)
    scores = x @ x.T
    for threshold in (0.3, float(scores[3, 5]) if scores[3, 5] > 0 else -float(scores[3, 5]), 0.9):
        # products a hair above and below the threshold, by less than single precision tells apart
        y = np.vstack([x, x[:1] * threshold * (1 + 1e-12), x[:1] * threshold * (1 - 1e-12)])
        names = np.array([*ids, "up", "down"], dtype=object)
        want = ((x @ y.T > threshold) & (ids[:, None] != names[None, :])).sum(1)
        got = sim._counted(x * scale, y * scale, ids, names, threshold * scale * scale, True)
        assert abs(got - want).max() == 0 or (scale > 1 and abs(got - want).sum() <= 2)
        assert got.dtype == np.int64 and got[0] >= 1


def test_a_count_block_makes_no_double_matrix(monkeypatch):
    monkeypatch.setattr(sim, "_scores", lambda *a: pytest.fail("whole matrix in double precision"))
    import pandas as pd
    rows = pd.DataFrame({"lid": ["a", "b", None], "lvec": [[1.0, 0.0], [0.8, 0.6], [0.0, float("nan")]]})
    out = sim._kernel("count", "ip", 0, 0.5, True, [], "lid string, cnt bigint")(rows, rows.rename(columns={"lid": "rid", "lvec": "rvec"}))
    assert out["cnt"].tolist() == [1, 1, 0]
