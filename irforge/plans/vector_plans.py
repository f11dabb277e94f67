"""Vector plans over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.functions.vectors import norm
from irforge.operators import clusters as C
from irforge.operators import similarity as sim
from irforge.operators import textprep as tp
from irforge.session import materialize
from irforge.sources import tables as T

# Test threshold for the neighbourhood (the reference's 0.58 finds almost no pairs in this data).
NEIGHBOR_THRESHOLD = 0.30
DENSE_DEPTH = 100


def _checksum(col: str):
    """Σ (i+1) * v_i — a scalar fingerprint of a vector for engine-independent comparison."""
    return F.aggregate(F.transform(F.col(col), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.unit_embeddings(spark, sf_dir)
    raw = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("docid"),
                                                     norm(F.col("embedding").cast("array<double>")).alias("raw_norm"))
    return e.join(raw, "docid").select("docid", F.round("raw_norm", 6).alias("raw_norm"),
                                       F.round(F.element_at("vec", 1), 6).alias("u1"),
                                       F.round(_checksum("vec"), 6).alias("checksum"))


def neighbor_counts(spark: SparkSession, sf_dir: str, threshold: float = NEIGHBOR_THRESHOLD) -> DataFrame:
    """Neighbours with cosine > threshold, self excluded, for every document."""
    e = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    c = sim.threshold_count(e, e, threshold, exclude_self=True)
    return e.select(F.col("docid").alias("lid")).join(c, "lid", "left").select(
        F.col("lid").alias("docid"), F.coalesce("cnt", F.lit(0)).cast("bigint").alias("n_neighbors"))


def _label_assign(spark, sf_dir, unit: bool):
    if unit:
        return T.unit_embeddings(spark, sf_dir).select("docid", "vec", F.col("label").alias("cid"))
    return T.embeddings(spark, sf_dir).select("docid", "vec", F.col("label").alias("cid"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _label_assign(spark, sf_dir, True)
    k = a.agg(F.max("cid")).first()[0] + 1
    return C.cluster_sizes(a, k)


def cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.cluster_means(_label_assign(spark, sf_dir, True))
    return m.select("cid", F.round(F.element_at("center", 1), 6).alias("c1"), F.round(_checksum("center"), 6).alias("checksum"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _label_assign(spark, sf_dir, False)
    centers = C.cluster_means(a, normalize=False)
    return C.nearest_centroid(a.select("docid", "vec"), centers).select("docid", "cid", F.round("dist", 6).alias("dist"))


def medoid_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _label_assign(spark, sf_dir, False)
    centers = C.cluster_means(a, normalize=False)
    return C.medoid_per_cluster(a.select("docid", "vec"), centers).select("cid", "docid", F.round("dist", 6).alias("dist"))


def nearest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = C.cluster_means(_label_assign(spark, sf_dir, True))
    return C.nearest_cluster(centers).select("cid", "near_cid", F.round("sim", 6).alias("sim"))


def cosine_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _label_assign(spark, sf_dir, False)
    return C.cosine_sse(a, C.cluster_means(a, normalize=False)).select(F.round("sse", 6).alias("sse"))


def dense_topk(spark: SparkSession, sf_dir: str, k: int = DENSE_DEPTH) -> DataFrame:
    """Exact inner-product top-k of every question embedding over the unit corpus."""
    q = T.shifted_unit_embeddings(spark, sf_dir, 7, 1)
    d = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    t = sim.topk(q, d, k, left_vec="qvec", right_vec="vec")
    return t.select(F.col("lid").alias("qid"), F.col("rid").alias("docid"), "score", "rank")


def token_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(docid, pos, mask, tvec): each 64-d vector re-read as 8 tokens of 8 dims (FIXTURES §3)."""
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    t = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"), "v")
    return t.select(F.col("vec_id").cast("string").alias("docid"), "pos",
                    F.when(F.pmod(F.col("vec_id") + F.col("pos"), F.lit(5)) == 0, 0).otherwise(1).alias("mask"),
                    F.slice("v", F.col("pos") * 8 + 1, F.lit(8)).alias("tvec"))


def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Σ mask * token vector / Σ mask per document (JVM vector mean over unmasked tokens)."""
    from irforge.operators.pooling import masked_mean
    p = masked_mean(token_embeddings(spark, sf_dir))
    return p.select("docid", "n_tokens", F.round(F.element_at("pooled", 1), 6).alias("p1"),
                    F.round(_checksum("pooled"), 6).alias("checksum"))


def silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _label_assign(spark, sf_dir, True)
    return C.silhouette(a, "vec", "docid", "cid").select(F.round("silhouette", 6).alias("silhouette"))


def label_mod_curve(spark: SparkSession, sf_dir: str, k_max: int = 10) -> DataFrame:
    """A deterministic SSE curve from the data: for k = 1..k_max the cosine SSE of the assignment
    label mod k with mean centres (each document is replicated k_max times, a fixed factor)."""
    a = _label_assign(spark, sf_dir, False)
    x = a.select("docid", "vec", "cid", F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"))
    x = x.withColumn("g", F.pmod(F.col("cid"), F.col("k")))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    from irforge.functions.vectors import cosine
    cen = (x.groupBy("k", "g").agg(Summarizer.mean(array_to_vector("vec")).alias("m"))
            .select("k", "g", vector_to_array("m").alias("center")))
    j = x.join(F.broadcast(cen), ["k", "g"])  # k_max * n_labels rows
    return j.groupBy("k").agg(F.sum(F.pow(1.0 - cosine("vec", "center"), 2)).alias("sse"))


def knee_of_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = label_mod_curve(spark, sf_dir)
    return C.knee_point(curve.select("k", F.round("sse", 9).alias("sse")), "k", "sse", fixed.KNEE_SENSITIVITY)


def sse_curve_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 on the raw vectors of the documents that the K-selection length rule keeps (rows-only: k-means is not
    reproducible across engines)."""
    kept = tp.filter_len_kselect(T.documents_with_dataset(spark, sf_dir), F.col("dataset")).select("docid")
    e = materialize(T.embeddings(spark, sf_dir).select("docid", "vec").join(kept, "docid", "left_semi"))
    return C.sse_curve(e, fixed.SSE_K_LIST, seed=560, max_iter=fixed.KMEANS_ITERATIONS)


def auto_select_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 (rows-only): the silhouette of every K of the grid; best K first."""
    e = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    best, curve = C.auto_select_k(e, seed=42)
    return curve.withColumn("is_best", F.col("k") == best)


def kmeans_assign(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """M1 (rows-only): k-means on unit vectors, nearest-centre assignment and distance."""
    e = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    model = C.kmeans_fit(e, k, seed=42, max_iter=300, n_init=10)
    centers = C.model_centers(spark, model)
    return C.nearest_centroid(e, centers)
