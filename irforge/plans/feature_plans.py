"""Document features and expert scoring plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.functions.vectors import l2
from irforge.operators import clusters as C
from irforge.operators import experts as X
from irforge.operators import lexical as lex
from irforge.operators import similarity as sim
from irforge.operators.common import bounded_broadcast
from irforge.session import materialize
from irforge.sources import tables as T

R = 6
NEIGHBOR_THRESHOLD = 0.30
#: Questions of a run, as the reference sets them.
TARGET_QUESTIONS = 1000


def docs_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with their (unit) embeddings on the string docid; label = cluster."""
    d = T.documents(spark, sf_dir)
    e = T.unit_embeddings(spark, sf_dir).select("docid", "vec", F.col("label").alias("cid"))
    return d.join(e, "docid")


def docs_with_embeddings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with_embeddings(spark, sf_dir).select("docid", F.length("doctext").cast("bigint").alias("n_chars"), "cid")


def features(spark: SparkSession, sf_dir: str, threshold: float = NEIGHBOR_THRESHOLD) -> DataFrame:
    """One row per document: docid, cid, n_neighbors, density, ni, dist, cluster_size."""
    # read by six branches below: written once instead of re-joining documents and vectors each time
    de = materialize(docs_with_embeddings(spark, sf_dir))
    density = lex.tfidf_density(de.select("docid", "doctext"))
    ni = lex.lexical_redundancy(de.select("docid", "doctext")).select("docid", "ni")
    nb = sim.threshold_count(de, de, threshold, exclude_self=True).select(F.col("lid").alias("docid"), F.col("cnt").alias("nb"))
    centers = C.cluster_means(de.select("vec", "cid"), normalize=False)
    dist = de.join(bounded_broadcast(centers, 100_000), "cid").select("docid", l2(F.col("vec"), F.col("center")).alias("dist"))
    sizes = C.cluster_sizes(de.select("cid")).withColumnRenamed("size", "cluster_size")
    return materialize(de.select("docid", "cid").join(density, "docid").join(ni, "docid").join(dist, "docid")
                       .join(nb, "docid", "left").join(sizes, "cid")
                       .select("docid", "cid", F.coalesce("nb", F.lit(0)).cast("bigint").alias("n_neighbors"),
                               "density", "ni", "dist", "cluster_size"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lex.tfidf(T.documents(spark, sf_dir))
    return w.select("docid", "term", "tf", F.round("w", R).alias("w"))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lex.tfidf(T.documents(spark, sf_dir))
    return lex.top_terms(w, 10).select("docid", "term", F.col("term_rank").cast("bigint").alias("term_rank"))


def tfidf_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = docs_with_embeddings(spark, sf_dir)
    return lex.tfidf_density(de.select("docid", "doctext")).select("docid", F.round("density", R).alias("density"))


def lexical_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = docs_with_embeddings(spark, sf_dir)
    return lex.lexical_redundancy(de.select("docid", "doctext")).select("docid", F.round("ni", R).alias("ni"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.corpus_stats(features(spark, sf_dir))
    return s.select(*[F.round(c, R).alias(c) for c in ("tfidf_min", "tfidf_max", "ni_mean", "ni_std", "dmin", "dmax")],
                    F.col("max_neighbors").cast("bigint").alias("max_neighbors"))


def expert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.expert_scores(features(spark, sf_dir))
    return s.select("docid", "cid", *[F.round(c, R).alias(c) for c in X.EXPERTS])


def _blended(spark, sf_dir):
    return X.blended_score(X.cluster_zscore(X.expert_scores(features(spark, sf_dir))))


def cluster_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = X.cluster_zscore(X.expert_scores(features(spark, sf_dir)))
    return z.select("docid", "cid", *[F.round(f"z{i}", R).alias(f"z{i}") for i in range(1, 5)])


def blended_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir).select("docid", "cid", F.round("blended", R).alias("blended"))


def cluster_best_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blended(spark, sf_dir).withColumn("blended", F.round("blended", 9))
    return X.best_per_cluster(b).select("cid", "docid", F.round("blended", R).alias("blended"))


def cluster_quota(spark: SparkSession, sf_dir: str, total: int = TARGET_QUESTIONS) -> DataFrame:
    sizes = C.cluster_sizes(docs_with_embeddings(spark, sf_dir).select("cid"))
    return X.cluster_quota(sizes, total).select("cid", F.col("size").cast("bigint").alias("size"), "quota")


def cluster_schedule(spark: SparkSession, sf_dir: str, total: int = TARGET_QUESTIONS) -> DataFrame:
    sizes = C.cluster_sizes(docs_with_embeddings(spark, sf_dir).select("cid"))
    return X.cluster_schedule(X.cluster_quota(sizes, total), total)
