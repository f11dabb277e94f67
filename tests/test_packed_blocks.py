"""Two large sides: packed blocks give the results of a small side that is sent out, and no row moves once for each block it meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from irforge.operators import similarity as sim


def _frame(spark, n=300, dims=6):
    x = np.random.default_rng(6).normal(size=(n, dims))
    x[20:60] = x[20]                          # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(f"{i:03d}", v, i, i % 5, [i % 5, (i + 1) % 5], f"{(i * 7) % n:03d}") for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "docid string, vec array<double>, seq long, cid int, near array<int>, other string") \
        .withColumn("own", F.round(F.col("vec")[0], 6)).repartition(5)


CASES = {
    "topk": ("topk", dict(k=7)), "nearest": ("topk", dict(k=3, metric="l2")), "count": ("count", dict(threshold=0.4, exclude_self=True)),
    "edges": ("edges", dict(threshold=0.6, left_cols={"lorder": "seq"}, right_cols={"rorder": "seq"})), "edges_ge": ("edges_ge", dict(threshold=0.6)),
    "rank": ("rank", dict(left_cols={"lthr": "own", "lexcl": "other"})), "max": ("max", dict(left_cols={"lorder": "seq"}, right_cols={"rorder": "seq"})),
    "group_best": ("group_best", dict(left_cols={"lgroups": "near", "lexcl": "docid"}, right_cols={"rgroup": "cid"})),
    "group_sum": ("group_sum", dict(metric="l2", exclude_self=True, right_cols={"rgroup": "cid"})),
}
FINAL = {"topk": lambda r, kw: sim.topk_per_group(r, ["lid"], [F.asc("score") if kw.get("metric") == "l2" else F.desc("score"), F.asc("rid")], kw["k"]),
         "count": lambda r, _: r.groupBy("lid").agg(F.sum("cnt")), "rank": lambda r, _: r.groupBy("lid").agg(F.sum("cnt")),
         "max": lambda r, _: r.groupBy("lid").agg(F.round(F.max("score"), 9)),
         "group_sum": lambda r, _: r.groupBy("lid", "rgroup").agg(F.round(F.sum("s"), 5), F.sum("n")),
         "group_best": lambda r, _: r.groupBy("lid", "rgroup").agg(F.round(F.max("score"), 9))}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("same", [True, False])
def test_packed_blocks_equal_a_small_side_sent_out(spark, monkeypatch, case, same):
    mode, kw = CASES[case]
    d = _frame(spark)
    other = d if same else d.where("seq % 3 != 1")
    final = FINAL.get(mode, lambda r, _: r.withColumn("score", F.round("score", 9)))
    want = sorted(tuple(r) for r in final(sim.block_join(d, other, mode, **kw), kw).collect())
    monkeypatch.setattr(sim, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(sim, "MERGE_ROWS", 50)
    assert sorted(tuple(r) for r in final(sim.block_join(d, other, mode, block_rows=32, **kw), kw).collect()) == want and want


@pytest.mark.parametrize("mode", ["count", "edges", "topk"])
def test_no_shuffle_between_blocks(spark, monkeypatch, mode):
    d = _frame(spark)
    monkeypatch.setattr(sim, "BROADCAST_BYTES", 0)
    plan = sim.block_join(d, d, mode, threshold=0.4, block_rows=32)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan


def test_written_bytes_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sim, "BROADCAST_BYTES", 0)
    written = []
    whole = sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df: written.append(whole(df)) or written[-1])
    sizes = []
    for n in (200, 800):
        written.clear()
        d = _frame(spark, n)
        assert sim.threshold_count(d, d, 0.4, exclude_self=True, block_rows=16).agg(F.sum("cnt")).first()[0] > 0
        sizes.append(written[-1].agg(F.sum(F.length("data"))).first()[0])
    assert sizes[1] < 5 * sizes[0]
