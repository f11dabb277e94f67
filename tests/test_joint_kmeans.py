"""Joint Lloyd: each model as if fitted alone, jobs an iteration independent of the models, the curve saved K by K."""

import numpy as np
from pyspark.sql import functions as F

from irforge.operators import clusters as C
from irforge.operators import joint_kmeans as joint


def _blobs(spark, n=120):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 4, (6, 5))[rng.integers(0, 6, n)] + rng.normal(0, 0.4, (n, 5))
    x[7] = x[3]                               # repeated rows
    return x, spark.createDataFrame([(f"{i:03d}", v) for i, v in enumerate(x.tolist())], "docid string, vec array<double>").repartition(4).cache()


def _alone(x, centers, max_iter=100, tol=1e-4):
    for _ in range(max_iter):
        cell = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[cell == j].mean(axis=0) if (cell == j).any() else centers[j] for j in range(len(centers))])
        done = np.sqrt(((new - centers) ** 2).sum(axis=1)).max() <= tol
        centers = new
        if done:
            break
    return centers


def test_each_model_equals_lloyd_alone(spark):
    x, df = _blobs(spark)
    specs = [(2, 0), (6, 0), (6, 1), (15, 2)]
    first = joint.starts(df, specs, 5, "vec", "docid")
    assert all(len(m.centers) == m.k for m in first)
    for m, f in zip(joint.fit(df, specs, 5), first):
        want = _alone(x, f.centers)
        assert np.allclose(m.centers, want)
        cell = ((x[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert [r["c"] for r in df.select("docid", joint.cell_of(df, m).alias("c")).orderBy("docid").collect()] == cell.tolist()
        assert abs(m.cost - ((x - want[cell]) ** 2).sum()) < 1e-3


def test_passes_do_not_depend_on_the_number_of_models(spark, monkeypatch):
    _, df = _blobs(spark)
    passes = []
    whole = joint._sums
    monkeypatch.setattr(joint, "_sums", lambda *a: passes.append(1) or whole(*a))
    models = joint.fit(df, [(k, i) for k in (2, 6, 9) for i in range(3)], 5)
    assert len(passes) == max(m.iterations for m in models)


def test_curve_is_saved_and_skips_large_k(spark, tmp_path):
    x, df = _blobs(spark)
    path = str(tmp_path / "curve")
    curve = {r["k"]: r["sse"] for r in C.sse_curve(df, [2, 6, 120, 500], seed=5, path=path).collect()}
    assert sorted(curve) == [2, 6]
    assert {r["k"]: r["sse"] for r in spark.read.json(path).collect()} == curve
    for m in joint.fit(df, [(2, 0), (6, 0)], 5):
        own = m.centers[((x[:, None] - m.centers[None]) ** 2).sum(axis=2).argmin(axis=1)]
        cos = (x * own).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(own, axis=1)
        assert abs(curve[m.k] - ((1 - cos) ** 2).sum()) < 1e-9
    assert C.sse_curve(df.limit(0), [2], seed=5).count() == 0


def test_auto_select_finds_the_blobs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 9, (8, 4)).repeat(25, axis=0) + rng.normal(0, 0.05, (200, 4))
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(x.tolist())], "docid string, vec array<double>")
    best, curve = C.auto_select_k(df, n_init=5)
    assert best == 8 and curve.where(F.col("silhouette") > 0.9).count() >= 1


def test_models_of_held_rows_equal_the_joint_passes(spark, monkeypatch):
    _, df = _blobs(spark)
    specs = [(k, i) for k in (2, 6, 30) for i in range(3)]
    all_models = joint.fit(df, specs, 5, spread=True)
    passes = []
    monkeypatch.setattr(joint, "_sums", lambda *a: passes.append(1))
    found = joint.fit(df, specs, 5, spread=True, best=True)
    assert not passes and [m.k for m in found] == [2, 6, 30]
    for m in found:
        want = min((a for a in all_models if a.k == m.k), key=lambda a: (a.cost, a.start))
        assert m.start == want.start and m.iterations == want.iterations and abs(m.cost - want.cost) < 1e-6 and np.allclose(m.centers, want.centers)


def test_comparing_with_moved_centres_is_lloyd():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6))
    x[2000:2030] = x[2000]
    start = x[:400].copy()
    centers, cost, n = joint.lloyd(x, x.astype(np.float32), start, 100, 1e-4)
    far = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert 3 < n < 100 and far * (1 - 1e-9) <= cost <= far * 1.001
    assert np.allclose(centers, _alone(x, start))


def test_draws_in_turns_take_each_row_by_its_chance(monkeypatch):
    monkeypatch.setattr(joint, "TURN", 4)
    pool = np.array([[0.0], [1.0], [3.0], [3.0], [10.0]])
    seen = {}
    for draw in (joint.drawn, joint.drawn_in_turns):
        for seed in range(4000):
            chosen = draw(pool, 4, np.random.default_rng(seed))
            assert len(chosen) == 4 and len(set(pool[chosen, 0].tolist())) == 4
            seen.setdefault(draw.__name__, {}).setdefault(tuple(sorted(pool[chosen[:3], 0].tolist())), []).append(seed)
    share = {name: {c: len(s) / 4000 for c, s in found.items()} for name, found in seen.items()}
    for c in set(share["drawn"]) | set(share["drawn_in_turns"]):
        assert abs(share["drawn"].get(c, 0) - share["drawn_in_turns"].get(c, 0)) < 0.04
    big = np.random.default_rng(1).normal(size=(2000, 3)).repeat(2, axis=0)
    chosen = joint.drawn_in_turns(big, 2500, np.random.default_rng(2))
    assert len(chosen) == 2500 and len({i // 2 for i in chosen}) == 2000  # no row twice before all are taken
