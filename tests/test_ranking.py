"""Tail negatives (all ranking lengths), metrics on hand-made runs, rank ties."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from irforge.operators import evaluation as ev
from irforge.operators.mining import tail_negatives


def test_tail_negatives_python_slicing_all_lengths(spark):
    n = 4
    runs, texts = [], []
    for length in range(0, 13):
        for r in range(1, length + 1):
            runs.append((f"q{length}", f"d{length}_{r}", r))
            texts.append((f"d{length}_{r}", "" if r % 5 == 0 else f"text {r}"))
    run = spark.createDataFrame(runs, "qid string, docid string, rank int")
    tx = spark.createDataFrame(texts, "docid string, text string")
    got = {}
    for row in tail_negatives(run, tx, n, compat=True).collect():
        got.setdefault(row["qid"], []).append((row["neg_no"], row["docid"]))
    for length in range(0, 13):
        ids = [f"d{length}_{r}" for r in range(1, length + 1)]
        want = [d for d in ids[len(ids) - 2 * n:]][:n]
        assert [d for _, d in sorted(got.get(f"q{length}", []))] == want


def test_metrics_hand_made(spark):
    run = spark.createDataFrame([("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "c", 2.0), ("q2", "x", 1.0)],
                                "qid string, docid string, score double")
    qrels = spark.createDataFrame([("q1", "c", 1), ("q1", "z", 2), ("q3", "y", 1)], "qid string, docid string, rel int")
    pq = {r["qid"]: r for r in ev.per_query_metrics(run, qrels).collect()}
    # ties broken by docid descending: order a, c, b
    dcg = 1 / math.log2(3)
    idcg = 2 / math.log2(2) + 1 / math.log2(3)
    assert abs(pq["q1"]["ndcg_10"] - dcg / idcg) < 1e-12
    assert abs(pq["q1"]["recall_100"] - 0.5) < 1e-12
    assert abs(pq["q1"]["rr_10"] - 0.5) < 1e-12
    assert abs(pq["q1"]["ap_100"] - (0.5 / 2)) < 1e-12
    assert pq["q3"]["ndcg_10"] == 0.0 and "q2" not in pq


def test_rank_run_ties_by_docid(spark):
    run = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "qid string, docid string, score double")
    got = [(r["docid"], r["rank"]) for r in ev.rank_run(run).orderBy("rank").collect()]
    assert got == [("c", 1), ("a", 2), ("b", 3)]


def _bm25_rows(n_docs=300, n_queries=12, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    text = lambda m: " ".join(rng.choice(vocab[:rng.choice([5, 20, 80])]) for _ in range(m))
    docs = [(f"d{i:04d}", text(rng.choice([0, 1, 8, 30])), text(rng.choice([0, 3]))) for i in range(n_docs)]
    docs += [(f"c{i}", docs[7][1], docs[7][2]) for i in range(20)]  # ties
    return docs, [(f"q{i}", text(rng.choice([1, 2, 6]))) for i in range(n_queries)] + [("none", "absent"), ("blank", "")]


def _bm25_brute(docs, queries, k, boosts=(1.0, 0.5), k1=0.9, b=0.4):
    out = {}
    fields = [[(i, d[1 + f].split()) for i, d in enumerate(docs)] for f in range(2)]
    for qid, q in queries:
        score = {}
        for boost, own in zip(boosts, fields):
            live = [t for _, t in own if t]
            avg = sum(map(len, live)) / len(live)
            for term in q.split():
                df = sum(term in t for _, t in own)
                for i, t in own:
                    if term in t:
                        tf = t.count(term)
                        score[docs[i][0]] = score.get(docs[i][0], 0.0) + boost * math.log(1 + (len(live) - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len(t) / avg))
        out[qid] = sorted(((-round(s, 6), d) for d, s in score.items()))[:k]
    return {(q, d): (rank, -s) for q, best in out.items() for rank, (s, d) in enumerate(best, 1)}


@pytest.mark.parametrize("block,query_terms,k", [(4096, 500_000, 10), (7, 9, 10), (3, 500_000, 1), (50, 3, 1000)])
def test_bm25_blocks_equal_brute_force(spark, monkeypatch, block, query_terms, k):
    from irforge.operators import lexical as lex
    monkeypatch.setattr(lex, "BLOCK_DOCS", block)
    monkeypatch.setattr(lex, "QUERY_TERMS", query_terms)
    docs, queries = _bm25_rows()
    run = lex.bm25(spark.createDataFrame(docs, "docid string, text string, title string").repartition(3), spark.createDataFrame(queries, "qid string, query string"), {"text": 1.0, "title": 0.5}, k=k)
    got = {(r.qid, r.docid): (r.rank, r.score) for r in run.collect()}
    want = _bm25_brute(docs, queries, k)
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}
    assert all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_bm25_skips_blocks_and_scores_in_place(spark):
    from irforge.operators import lexical as lex
    passed = []
    add = lex.TopScores.add
    try:
        lex.TopScores.add = lambda self, q, score, rows, ids: (passed.append(q), add(self, q, score, rows, ids))[1]
        terms = lex.QuerySlice(["q"], pa.array(["a"]), np.array([0]), np.array([0]), np.array([1.0]))
        sent = type("Sent", (), {"value": terms})()
        # the strong documents come first, so later blocks cannot reach the k-th best score
        rows = [pa.record_batch([pa.array([f"d{i}" for i in range(at, at + 10)]), pa.array([[{"term": "a", "tf": max(1, 50 - at)}]] * 10), pa.array([50] * 10)], names=["docid", "tfs_text", "dl_text"]) for at in range(0, 100, 10)]

        class Frame:
            def select(self, *cols):
                return self

            def mapInArrow(self, fn, schema):
                return [r for b in fn(iter(rows)) for r in b.to_pylist()]

        out = lex.block_scores(Frame(), sent, [("text", np.array([1.0]), 50.0)], 3, 0.9, 0.4, "docid")
    finally:
        lex.TopScores.add = add
    assert [r["docid"] for r in out] == ["d0", "d1", "d2"] and len(passed) == 1
    df = spark.createDataFrame([("d1", "apple pear", "")], "docid string, text string, title string")
    plan = lex.bm25(df, spark.createDataFrame([("q", "apple")], "qid string, query string"), {"text": 1.0})._jdf.queryExecution().toString()
    assert "hashpartitioning(qid" in plan and "HashAggregate" not in plan


def test_training_rows_join_the_texts_of_all_documents_once_for_each_use(spark):
    """The questions and the negatives are written: no plan of the training rows mines or cleans a second time."""
    from irforge.plans import training_plans as tp
    from tests.conftest import SF_SMALL
    plan = tp.rerank_train(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "regexp_replace" not in plan and "Window" not in plan
    assert "conversations.parquet" not in tp.triples(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    rows = tp.rerank_train(spark, SF_SMALL).groupBy("qid").agg({"neg_no": "max", "label": "sum"}).collect()
    assert rows and all(1 <= r["max(neg_no)"] <= 4 and r["sum(label)"] == 1.0 for r in rows)
