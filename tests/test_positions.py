"""Positions without a global window (J2), greedy first-wins over edge lists (M13), the missing count."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from irforge.operators.common import with_position
from irforge.operators.mining import tail_negatives
from irforge.operators.rewards import greedy_first_wins


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_positions_are_those_of_a_sort(spark, partitions):
    values = [random.Random(5).randrange(10**6) for _ in range(3000)] + [None] * 3 + [-1] * 500
    df = spark.createDataFrame([(v, str(i)) for i, v in enumerate(values)], "v long, k string").repartition(partitions)
    out = with_position(df, "v", "k")
    got = [(r.v, r.k) for r in sorted(out.collect(), key=lambda r: r.seq)]
    assert [r.seq for r in sorted(out.collect(), key=lambda r: r.seq)] == list(range(len(values)))
    assert got == sorted(((v, str(i)) for i, v in enumerate(values)), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    assert out.columns == ["v", "k", "seq"] and out.schema["seq"].dataType.typeName() == "long"


def test_positions_of_ties_are_distinct_and_plans_have_no_python(spark):
    out = with_position(spark.createDataFrame([(1,)] * 50, "v int"), "v")
    assert sorted(r.seq for r in out.collect()) == list(range(50))
    assert "Python" not in out._jdf.queryExecution().toString() and "ExternalRDD" not in out._jdf.queryExecution().toString()
    assert with_position(spark.createDataFrame([], "v int"), "v").count() == 0


def greedy(nodes, edges):
    before = {}
    for n, p in edges:
        before.setdefault(n, []).append(p)
    accepted = {}
    for n in nodes:
        accepted[n] = not any(accepted[p] for p in before.get(n, []))
    return accepted


def solve(spark, nodes, edges):
    out, rounds = greedy_first_wins(spark.createDataFrame([(n,) for n in nodes], "node string"),
                                    spark.createDataFrame(edges, "node string, prev string"))
    return {r.node: r.accepted for r in out.collect()}, rounds


def test_a_chain_takes_logarithmic_rounds(spark):
    nodes = [f"n{i:05d}" for i in range(10_000)]
    got, rounds = solve(spark, nodes, list(zip(nodes[1:], nodes)))
    assert got == {n: i % 2 == 0 for i, n in enumerate(nodes)}
    assert rounds <= 16


@pytest.mark.parametrize("seed,degree", [(1, 0.6), (2, 1.2), (3, 3.0)])
def test_random_graphs_equal_the_sequential_loop(spark, seed, degree):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(300)]
    edges = {(nodes[i], nodes[rng.randrange(max(0, i - 9), i)]) for i in range(1, 300) for _ in range(4) if rng.random() < degree / 4}
    got, _ = solve(spark, nodes, sorted(edges) * 2)
    assert got == greedy(nodes, edges)


def test_no_edges_and_no_nodes(spark):
    assert solve(spark, ["a", "b"], []) == ({"a": True, "b": True}, 0)
    assert solve(spark, [], []) == ({}, 0)


@pytest.mark.parametrize("drop_empty,missing", [(False, 3), (True, 6)])
def test_missing_texts_are_counted_in_the_same_pass(spark, drop_empty, missing):
    run = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(12)], "qid string, docid string, rank int")
    texts = spark.createDataFrame([(f"d{i}", "" if i % 4 == 1 else f"t{i}") for i in range(12) if i % 4], "docid string, text string")
    seen = Observation("missing")
    out = tail_negatives(run, texts, 6, drop_empty=drop_empty, missing=seen)
    assert out.select(F.count("docid")).first()[0] == min(6, 12 - missing)
    assert seen.get == {"n_missing": missing, "n_tail": 12}
