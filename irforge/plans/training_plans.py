"""Training and test set plans (M21, M22, M23 with T3, J4, J5, J15, S7, X3, A16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.operators import evaluation as ev
from irforge.operators import mining as mn
from irforge.operators import rerank as rr
from irforge.operators import similarity as sim
from irforge.operators import textprep as tp
from irforge.plans.retrieval import bm25_run, qrels
from irforge.session import materialize
from irforge.sources import tables as T

R = 6
DENSE_DEPTH = 100


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, qtext, doctext): cleaned, ASCII, one per source document."""
    q = tp.cleaned_questions(T.generated_questions(spark, sf_dir))
    return q.select(F.col("docid").alias("qid"), F.col("question").alias("qtext"), "doctext")


def lookup_texts(spark: SparkSession, sf_dir: str, sep: str = " ") -> DataFrame:
    """J4 source: docid -> title + sep + text."""
    c = T.corpus(spark, sf_dir)
    return c.select("docid", F.concat(F.col("title"), F.lit(sep), F.col("text")).alias("text"))


def dense_run(spark: SparkSession, sf_dir: str, k: int = DENSE_DEPTH, asked: DataFrame | None = None) -> DataFrame:
    """J10 for the cleaned questions: question embedding of docid d = unit(emb[d] + emb[(7d+1) mod n])."""
    qs = (questions(spark, sf_dir) if asked is None else asked).select("qid")
    qv = T.shifted_unit_embeddings(spark, sf_dir, 7, 1).withColumnRenamed("docid", "qid").join(qs, "qid", "left_semi")
    corpus = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    t = sim.topk(qv, corpus, k, left_id="qid", left_vec="qvec", right_vec="vec")
    return materialize(t.select(F.col("lid").alias("qid"), F.col("rid").alias("docid"), "score", "rank"))


def _negatives(spark, sf_dir, asked: DataFrame | None = None):
    return mn.tail_negatives(dense_run(spark, sf_dir, asked=asked), lookup_texts(spark, sf_dir), compat=True)


def tail_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir).select("qid", "docid", "neg_no")


def rerank_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive then negatives per question."""
    # either is read more than once: written, so that the texts of all documents are joined once for each
    asked = materialize(questions(spark, sf_dir))
    return mn.rerank_training_rows(asked, materialize(_negatives(spark, sf_dir, asked)))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21 / K13."""
    asked = materialize(questions(spark, sf_dir))
    return mn.triples(asked, _negatives(spark, sf_dir, asked))


def reranker_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.reranker_inputs(rerank_train(spark, sf_dir))


def _testset(spark, sf_dir):
    texts = lookup_texts(spark, sf_dir, ". ")
    return rr.nested_testset(bm25_run(spark, sf_dir), T.queries(spark, sf_dir), texts)


def rerank_testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M22 / J5 summary: per query its passages in score order (ids joined) and total text size."""
    n = _testset(spark, sf_dir)
    return n.select("qid", F.col("qtext.title").alias("query"), F.size("passages").cast("bigint").alias("n_passages"),
                    F.array_join(F.transform("passages", lambda p: p["docid"]), ",").alias("docids"),
                    F.aggregate("passages", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p["text"])).alias("text_chars"))


def explode_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested test set flattened back to (qid, query, docno, text)."""
    e = rr.explode_testdata(_testset(spark, sf_dir))
    return e.select("qid", "query", "docno", F.col("pos").cast("bigint").alias("pos"), F.length("text").cast("bigint").alias("text_len"))


def _reranked(spark, sf_dir):
    flat = rr.explode_testdata(_testset(spark, sf_dir)).select("qid", "query", F.col("docno").alias("docid"), "text")
    return rr.rerank(flat)


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 + F7 + W3: reranked run with log P(true) scores."""
    return _reranked(spark, sf_dir).select("qid", "docid", F.round("score", R).alias("score"), "rank")


def rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the reranked run against the qrels."""
    run = _reranked(spark, sf_dir).withColumn("score", F.round("score", 9))
    pq = ev.per_query_metrics(run, qrels(spark, sf_dir))
    return pq.select("qid", *[F.round(c, R).alias(c) for c in ("ndcg_10", "recall_100", "ap_100", "rr_10")])


def predictions_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 / K14 summary: per query the number of scored documents and the best one."""
    m = ev.predictions_map(_reranked(spark, sf_dir).withColumn("score", F.round("score", 6)))
    best = F.aggregate(F.map_entries("scores"), F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("double").alias("v")),
                       lambda acc, e: F.when(acc["v"].isNull() | (e["value"] > acc["v"]) | ((e["value"] == acc["v"]) & (e["key"] < acc["k"])),
                                             F.struct(e["key"].alias("k"), e["value"].alias("v"))).otherwise(acc))
    return m.select("qid", F.size("scores").cast("bigint").alias("n_scored"), best["k"].alias("best_docid"), best["v"].alias("best_score"))
