"""Representative-document sampling plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.operators import clusters as C
from irforge.operators import sampling as S
from irforge.operators import textprep as tp
from irforge.sources import tables as T

#: Documents sampled for a collection, as the reference sets them.
N_TRAIN = 1000
R = 6


def kept_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 then J3: raw embeddings of documents that pass the per-dataset length rule."""
    d = tp.filter_len_sampling(T.documents_with_dataset(spark, sf_dir), F.col("dataset"))
    e = T.embeddings(spark, sf_dir)
    return e.join(d.select("docid"), "docid", "left_semi")


def _label_clusters(spark, sf_dir):
    e = kept_embeddings(spark, sf_dir).select("docid", "vec", F.col("label").alias("cid"))
    centers = C.cluster_means(e, normalize=False)
    return e, centers


def sample_size_per_cluster(spark: SparkSession, sf_dir: str, n_train: int = N_TRAIN) -> DataFrame:
    e, _ = _label_clusters(spark, sf_dir)
    return S.sample_sizes(C.cluster_sizes(e), n_train).select("cid", F.col("size").cast("bigint").alias("size"), "sample_size")


def cluster_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, centers = _label_clusters(spark, sf_dir)
    p = S.cluster_softmax(C.doc_center_cosine(e, centers))
    return p.select("docid", "cid", F.round("cos", R).alias("cos"), F.round("p", R).alias("p"))


def sample_documents_from(e: DataFrame, centers: DataFrame, n_train: int, lam: float = 1.0) -> DataFrame:
    """M20 core on a given assignment: sizes -> quotas -> softmax -> 5 seeded weighted samples ->
    pool -> MMR against the centre's nearest document -> top sample_size per cluster (U2)."""
    sizes = S.sample_sizes(C.cluster_sizes(e), n_train)
    probs = S.cluster_softmax(C.doc_center_cosine(e, centers))
    pool = S.weighted_sample(probs, sizes)
    medoids = C.medoid_per_cluster(e.select("docid", "vec"), centers)
    seeds = medoids.join(e.select("docid", F.col("vec").alias("seed_vec")), "docid").select("cid", "seed_vec")
    pool_v = pool.join(e.select("docid", "vec"), "docid")
    return S.mmr_select(pool_v, seeds, sizes, lam)


def weighted_sample_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 + U1 (rows-only): the union of the five seeded weighted samples of every cluster."""
    e, centers = _label_clusters(spark, sf_dir)
    sizes = S.sample_sizes(C.cluster_sizes(e), N_TRAIN)
    return S.weighted_sample(S.cluster_softmax(C.doc_center_cosine(e, centers)), sizes)


def sample_documents(spark: SparkSession, sf_dir: str, n_train: int = N_TRAIN, lam: float = 1.0) -> DataFrame:
    """M20 (rows-only): k-means (100 iterations, seed 420) on the kept raw vectors with
    n_clusters = 10, then the sampling chain; final picks with their texts (J4, K1 shape)."""
    kept = kept_embeddings(spark, sf_dir).select("docid", "vec")
    model = C.kmeans_fit(kept, 10, seed=420, max_iter=fixed.KMEANS_ITERATIONS)
    centers = C.model_centers(spark, model)
    assign = C.nearest_centroid(kept, centers).join(kept, "docid").select("docid", "vec", "cid")
    picks = sample_documents_from(assign, centers, n_train, lam)
    texts = T.documents(spark, sf_dir)
    return (picks.select("cid", "docid", F.round("mmr_score", R).alias("mmr_score"))
                 .join(texts, "docid").where(tp.present_text(F.col("doctext")))
                 .select("docid", "cid", "mmr_score", F.length("doctext").cast("bigint").alias("n_chars")))
