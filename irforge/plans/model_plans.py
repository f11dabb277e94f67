"""Plans for the model-facing operators (X1, X2, W10, J16, M19) on the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.functions.vectors import norm
from irforge.operators import ann
from irforge.operators import inference as inf
from irforge.operators import lexical as lex
from irforge.operators import similarity as sim
from irforge.operators.snippets import answer_snippets
from irforge.plans import feature_plans as fp
from irforge.session import materialize
from irforge.plans.vector_plans import token_embeddings
from irforge.sources import tables as T

R = 6


def _top_terms_de(spark, sf_dir):
    de = fp.docs_with_embeddings(spark, sf_dir).select("docid", "doctext")
    return de, lex.top_terms(lex.tfidf(de), fixed.SNIPPET_TERMS)


def answer_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    de, tt = _top_terms_de(spark, sf_dir)
    return answer_snippets(de, tt)


def generate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with the bundled template generator: 5 candidates per document."""
    _, tt = _top_terms_de(spark, sf_dir)
    return inf.template_candidates(tt, fixed.N_CANDS)


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 (rows-only) with the hashed stand-in encoder over every document."""
    e = inf.embed(T.documents(spark, sf_dir), "doctext", "vec")
    return e.select("docid", F.round(norm(F.col("vec")), R).alias("norm"), F.size("vec").alias("dim"))


def ivf_topk(spark: SparkSession, sf_dir: str, k: int = 100, recall: float = 0.92) -> DataFrame:
    """J16 (rows-only): approximate top-k of the question embeddings over the unit corpus, at the reference's
    search depth; as many cells are probed as the recall takes on these vectors (a little above 0.9, the mark to hold)."""
    docs = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    q = materialize(T.shifted_unit_embeddings(spark, sf_dir, 7, 1).withColumnRenamed("docid", "qid"))
    index = ann.ivf_index(docs)
    return ann.ivf_topk(q, index, k, ann.calibrate(q, docs, index, k, recall)).select("qid", "docid", "score", "rank")


def late_interaction(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """MaxSim of every question (8 tokens of 8 dims) against its dense top-k documents."""
    q = T.shifted_unit_embeddings(spark, sf_dir, 7, 1)
    corpus = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    run = sim.topk(q, corpus, k, left_vec="qvec", right_vec="vec").select(F.col("lid").alias("qid"), F.col("rid").alias("docid"))
    qtok = q.select(F.col("docid").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("qpos"), "qvec") \
            .select("qid", "qpos", F.slice("qvec", F.col("qpos") * 8 + 1, F.lit(8)).alias("qv"))
    dtok = token_embeddings(spark, sf_dir).select("docid", "pos", F.col("tvec").alias("dv"), "mask")
    m = ann.maxsim(run, qtok, dtok)
    return m.select("qid", "docid", F.round("maxsim", R).alias("maxsim"))


def exemplar_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 (rows-only): three exemplars from lexical clusters of the documents with embeddings."""
    from irforge.operators.sampling import exemplar_sample as ex
    de = fp.docs_with_embeddings(spark, sf_dir).select("docid", "doctext")
    return ex(de, lex.tfidf_by_id(de))
