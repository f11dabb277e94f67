"""Hand-made edge rows of FIXTURES §4 for snippets, schedule, dynamic threshold and experts."""

import numpy as np

from irforge.operators import experts as X
from irforge.operators import rewards as RW
from irforge.operators.snippets import answer_snippets


def test_snippet_windows_70_71_140_and_ties(spark):
    words = [f"w{i}" for i in range(200)]
    docs = {
        "a": " ".join(words[:70]),
        "b": " ".join(words[:71]),
        "c": " ".join(words[:140]),
        "d": " ".join(words[:105]) + " KEY " + " ".join(words[105:180]),
        "e": " ".join(["x"] * 150),
    }
    keys = {"a": ["w1"], "b": ["w70"], "c": ["w100", "w139"], "d": ["key"], "e": ["zz"]}
    d = spark.createDataFrame(list(docs.items()), "docid string, doctext string")
    tt = spark.createDataFrame([(k, t, i + 1) for k, ts in keys.items() for i, t in enumerate(ts)],
                               "docid string, term string, term_rank int")
    got = {r["docid"]: (r["start"], r["snippet"]) for r in answer_snippets(d, tt).collect()}
    assert got["a"] == (-1, docs["a"])  # 70 tokens: no window
    assert got["b"] == (0, " ".join(words[:70]))  # 71 tokens: only the first window, without w70
    assert got["c"] == (70, " ".join(words[70:140]))  # windows at 0, 35, 70: only the last has both terms
    assert got["d"] == (70, " ".join(words[70:105] + ["KEY"] + words[105:139]))  # token 105: windows 70 and 105, the first wins
    assert got["e"] == (0, " ".join(["x"] * 70))  # no term anywhere


def test_schedule_exact_tie(spark):
    q = spark.createDataFrame([(0, 2), (1, 4)], "cid int, quota long")
    got = [(r["step"], r["cid"]) for r in X.cluster_schedule(q, 6).orderBy("step").collect()]
    # brute force: always the cluster with the smallest selected/quota, ties -> lowest cid
    sel, quota, want = [0, 0], [2, 4], []
    for step in range(1, 7):
        cand = [c for c in (0, 1) if sel[c] < quota[c]]
        c = min(cand, key=lambda c: (sel[c] / quota[c], c))
        want.append((step, c))
        sel[c] += 1
    assert got == want


def test_dynamic_threshold_short_history_and_clip(spark):
    vals = [0.5, 0.99, 0.97, 0.2, 0.98, 0.96, 0.3, 0.91]
    h = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "seq long, value double")
    got = [(r["threshold"], r["is_dup"]) for r in RW.dynamic_threshold(h).orderBy("seq").collect()]
    for i, (thr, dup) in enumerate(got):
        prev = vals[:i]
        want = 0.90 if len(prev) <= 4 else float(np.clip(np.quantile(prev, 0.75), 0.88, 0.95))
        assert abs(thr - want) < 1e-12
        assert dup == (vals[i] >= want)


def test_singleton_cluster_centrality_and_zscore(spark):
    f = spark.createDataFrame(
        [("a", 0, 3, 0.2, 0.1, 0.5, 1), ("b", 1, 1, 0.4, 0.3, 0.7, 2), ("c", 1, 0, 0.1, 0.9, 0.9, 2)],
        "docid string, cid int, n_neighbors long, density double, ni double, dist double, cluster_size long")
    s = {r["docid"]: r for r in X.expert_scores(f).collect()}
    assert s["a"]["s4"] == 0.85
    z = {r["docid"]: r for r in X.cluster_zscore(X.expert_scores(f)).collect()}
    assert all(z["a"][f"z{i}"] == 0.0 for i in range(1, 5))
    assert abs(s["b"]["s1"] - 1 / 3) < 1e-12
