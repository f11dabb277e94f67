"""Weight policy fold against steps worked out by hand, knee finder, sampling sizes."""

import numpy as np

from irforge.operators import clusters as C
from irforge.operators import policy as P
from irforge.operators import sampling as S


def steps_frame(spark):
    """Two steps of ten; the first three tenths are the warm-up."""
    rows = [(1, [1.0, 0.0, -1.0, 0.0], [0.8, 0.4, 0.4, 0.0], 0.5), (4, [0.0, 2.0, 0.0, -2.0], [0.1, 0.1, 0.1, 0.1], 0.3)]
    return spark.createDataFrame(rows, "step long, s array<double>, r array<double>, score double")


def test_moving_average_steps_by_hand(spark):
    a, b = sorted(P.weight_fold(steps_frame(spark), 10).collect(), key=lambda r: r["step"])
    # step 1: advantage 0.5 - 0; gradient 0.2 (1, 0, -1, 0) + 0.8 (0.4, 0, 0, -0.4) = (0.52, 0, -0.2, -0.32);
    # weights 0.25 + 0.3 * 0.5 * gradient = (0.328, 0.25, 0.22, 0.202), sum 1; then 0.9 w + 0.025
    assert np.allclose([a.w1, a.w2, a.w3, a.w4], [0.3202, 0.25, 0.223, 0.2068], atol=1e-12)
    assert np.allclose([a.advantage, a.baseline], [0.5, 0.025], atol=1e-12)
    # step 4: after the warm-up the gradient is (0, 2, 0, -2); advantage 0.3 - 0.025 = 0.275, moves 0.165;
    # (0.3202, 0.415, 0.223, 0.0418), floor 0.05 for the last, sum 1.0082, then 0.9 w / 1.0082 + 0.025
    assert np.allclose([b.w1, b.w2, b.w3, b.w4], [0.9 * x / 1.0082 + 0.025 for x in (0.3202, 0.415, 0.223, 0.05)], atol=1e-12)
    assert np.allclose([b.advantage, b.baseline], [0.275, 0.95 * 0.025 + 0.05 * 0.3], atol=1e-12)


def test_critic_steps_by_hand(spark):
    a, b = sorted(P.weight_fold(steps_frame(spark), 10, advantage="critic").collect(), key=lambda r: r["step"])
    # the critic starts at 0: advantage 0.5, logged value 0; it becomes 0.01 (1, 0, -1, 0) + 0.01
    assert np.allclose([a.w1, a.advantage, a.baseline], [0.3202, 0.5, 0.0], atol=1e-12)
    # step 4: value 0.01 * 0 + 0.01
    assert np.allclose([b.advantage, b.baseline], [0.29, 0.01], atol=1e-12)


def test_fold_continues_from_its_state(spark):
    log = steps_frame(spark)
    whole = {r.step: r for r in P.weight_fold(log, 10, advantage="critic").collect()}
    first = P.weight_fold(log.where("step = 1"), 10, advantage="critic", keep_state=True).first()
    state = {"w": [first.w1, first.w2, first.w3, first.w4], **first.state.asDict()}
    again = P.weight_fold(log.where("step = 4"), 10, advantage="critic", start=state).first()
    assert np.allclose([again.w1, again.w2, again.w3, again.w4, again.advantage], [whole[4].w1, whole[4].w2, whole[4].w3, whole[4].w4, whole[4].advantage], atol=1e-12)


def test_zero_weights_fall_back_to_uniform(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], -1e9)],
                               "step long, s array<double>, r array<double>, score double")
    r = P.weight_fold(df, 1, advantage="raw", use_floor=False, use_entropy=False).collect()[0]
    assert [r["w1"], r["w2"], r["w3"], r["w4"]] == [0.25] * 4


def test_knee_known_and_absent(spark):
    xs = [1, 2, 3, 4, 5, 6, 7, 8]
    convex = [100.0, 40.0, 20.0, 12.0, 9.0, 7.0, 6.0, 5.5]
    line = [8.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0]
    k1 = C.knee_point(spark.createDataFrame(list(zip(xs, convex)), "k int, sse double")).first()["knee"]
    k2 = C.knee_point(spark.createDataFrame(list(zip(xs, line)), "k int, sse double")).first()["knee"]
    assert k1 == 3.0
    assert k2 is None  # a flat curve has no knee (normalisation is undefined -> no candidate)


def test_sample_sizes_edges(spark):
    s1 = spark.createDataFrame([(0, 5), (1, 5)], "cid int, size long")
    got = {r["cid"]: r["sample_size"] for r in S.sample_sizes(s1, 12).collect()}
    # 1 + floor(10 * 5 / 10) = 6 each, total 12 -> no remaining, nobody topped up, clamped to size 5
    assert got == {0: 5, 1: 5}
    s2 = spark.createDataFrame([(0, 1), (1, 9)], "cid int, size long")
    got = {r["cid"]: r["sample_size"] for r in S.sample_sizes(s2, 1).collect()}
    assert all(0 <= v <= {0: 1, 1: 9}[c] for c, v in got.items())


def test_mmr_lambda_one_is_top_n_and_matches_brute_force():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(9, 4))
    seed = rng.normal(size=4)
    nx = np.linalg.norm(X, axis=1)
    s1 = X @ seed / (nx * np.linalg.norm(seed))
    s2 = (X @ X.T) / np.outer(nx, nx)
    ids = np.array([f"d{i}" for i in range(9)])
    res = S.mmr_order(s1, s2, ids, 1.0)
    assert [r[0] for r in res] == [ids[i] for i in np.argsort(-s1, kind="stable")]
    # brute force greedy for lambda = 0.5
    lam, chosen, left, want = 0.5, [], set(range(9)), []
    while left:
        sc = {x: lam * s1[x] - (1 - lam) * max([s2[x][y] for y in chosen] or [0]) for x in left}
        best = max(sorted(left, key=lambda x: ids[x]), key=lambda x: sc[x])
        want.append((ids[best], sc[best]))
        chosen.append(best)
        left.remove(best)
    got = S.mmr_order(s1, s2, ids, lam)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])


def test_mmr_with_callables_matches_builtin(spark):
    from irforge.operators.inference import mmr_with
    rng = np.random.default_rng(7)
    X = rng.normal(size=(8, 4))
    seed = rng.normal(size=4)
    pool = spark.createDataFrame([(0, f"d{i}", [float(v) for v in x]) for i, x in enumerate(X)], "cid int, docid string, vec array<double>")
    seeds = spark.createDataFrame([(0, [float(v) for v in seed])], "cid int, seed_vec array<double>")
    cos = lambda A, s: A @ s / (np.linalg.norm(A, axis=1) * np.linalg.norm(s))
    pair = lambda A: (A @ A.T) / np.outer(np.linalg.norm(A, axis=1), np.linalg.norm(A, axis=1))
    got = [r["docid"] for r in mmr_with(pool, seeds, cos, pair, 0.5).orderBy("mmr_step").collect()]
    want = [r[0] for r in S.mmr_order(cos(X, seed), pair(X), np.array([f"d{i}" for i in range(8)]), 0.5)]
    assert got == want
