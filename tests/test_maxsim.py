"""Late interaction on packed token matrices against plain loops."""

import numpy as np

from irforge.operators import ann


def test_maxsim_equals_loops_and_keeps_one_row_a_pair(spark):
    rng = np.random.default_rng(6)
    q = {f"q{i}": rng.normal(size=(1 + i, 3)) for i in range(3)}
    d = {f"d{i}": rng.normal(size=(2 + i, 3)) for i in range(4)}
    d["d1"][0] = q["q2"][1]                  # an equal token
    qtok = spark.createDataFrame([(k, i, v.tolist()) for k, m in q.items() for i, v in enumerate(m)], "qid string, qpos int, qv array<double>").repartition(3)
    dtok = spark.createDataFrame([(k, i, v.tolist(), int(i != 1)) for k, m in d.items() for i, v in enumerate(m)], "docid string, dpos int, dv array<double>, mask int").repartition(3)
    pairs = spark.createDataFrame([(a, b) for a in q for b in d] + [("q0", "none"), ("none", "d0")], "qid string, docid string")
    out = ann.maxsim(pairs, qtok, dtok)
    got = {(r["qid"], r["docid"]): r["maxsim"] for r in out.collect()}
    assert set(got) == {(a, b) for a in q for b in d}
    for (a, b), s in got.items():
        kept = np.delete(d[b], 1, axis=0)
        assert abs(s - sum(max(-((x - y) ** 2).sum() for y in kept) for x in q[a])) < 1e-9


def test_maxsim_without_pairs_or_tokens(spark):
    qtok = spark.createDataFrame([("q", 0, [1.0])], "qid string, qpos int, qv array<double>")
    dtok = spark.createDataFrame([("d", 0, [1.0], 0)], "docid string, dpos int, dv array<double>, mask int")
    pairs = spark.createDataFrame([("q", "d")], "qid string, docid string")
    assert ann.maxsim(pairs, qtok, dtok).count() == 0
    assert ann.maxsim(pairs.limit(0), qtok, dtok.withColumn("mask", dtok["dpos"] + 1)).count() == 0
