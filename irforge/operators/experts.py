"""Expert scores, per-cluster z-scores, blending, selection and the cluster schedule
(A4, M6, W2, M7, T5, Q2, T6).

Inputs are one-row-per-document feature tables; corpus scalars (min/max/mean/std) are computed by
one aggregate and applied as literals, so each expert is a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irforge.functions import fixed

EXPERTS = ["s1", "s2", "s3", "s4"]


def corpus_stats(features: DataFrame) -> DataFrame:
    """A4: one row of corpus scalars used by the experts.

    tfidf_min/max include 0 and 1 (min with initial 0, max with initial 1); ni_std is the
    population std + 1e-8; dmin/dmax are global distances to the assigned centre.
    """
    return features.agg(
        F.least(F.min("density"), F.lit(0.0)).alias("tfidf_min"),
        F.greatest(F.max("density"), F.lit(1.0)).alias("tfidf_max"),
        F.avg("ni").alias("ni_mean"),
        (F.stddev_pop("ni") + F.lit(1e-8)).alias("ni_std"),
        F.min("dist").alias("dmin"), F.max("dist").alias("dmax"),
        F.max("n_neighbors").alias("max_neighbors"))


def expert_scores(features: DataFrame, sqrt_neighbor: bool = False,
                  singleton_value: float = fixed.SINGLETON_CENTRALITY) -> DataFrame:
    """M6: s1 neighbourhood, s2 sigmoid TF-IDF density, s3 Gaussian redundancy, s4 centrality.

    ``features``: docid, cid, n_neighbors, density, ni, dist, cluster_size.
    """
    st = corpus_stats(features).first()
    max_nb = max(1, int(st["max_neighbors"] or 0))
    denom = max(1e-8, float(st["tfidf_max"]))
    tmin = float(st["tfidf_min"])
    mu, sd = float(st["ni_mean"]), float(st["ni_std"])
    dmin, dmax = float(st["dmin"]), float(st["dmax"])
    s1 = F.col("n_neighbors") / F.lit(float(max_nb))
    if sqrt_neighbor:
        s1 = F.sqrt(F.greatest(s1, F.lit(0.0)))
    s2 = 1.0 / (1.0 + F.exp(-((F.col("density") * denom - tmin) / denom)))
    s3 = F.lit(1.0) if sd <= 1e-8 else F.exp(-F.pow(F.col("ni") - mu, 2) / (2.0 * sd * sd))
    s4 = F.when(F.col("cluster_size") == 1, F.lit(singleton_value)).otherwise(
        F.least(F.greatest((F.lit(dmax) - F.col("dist")) / max(1e-8, dmax - dmin), F.lit(0.0)), F.lit(1.0)))
    return features.select("docid", "cid", s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), s4.alias("s4"))


def cluster_zscore(scores: DataFrame, z_temp: float = fixed.Z_TEMP, cols: list[str] = EXPERTS) -> DataFrame:
    """Per cluster (S - mean) / (population std + 1e-8) * z_temp for each expert.

    Means and deviations are one combined aggregation per cluster, joined back; a cluster that holds
    a third of the collection is a hot join key only, never a window in one task.
    """
    stats = scores.groupBy("cid").agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    out = scores.join(stats, "cid")
    return out.select(*scores.columns, *[((F.col(c) - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + 1e-8) * z_temp).alias(f"z{c[1:]}") for c in cols])


def blended_score(z: DataFrame, weights: list[float] = fixed.INIT_WEIGHTS, prefix: str = "z") -> DataFrame:
    """M7: S . w."""
    expr = sum((F.col(f"{prefix}{i + 1}") * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    return z.withColumn("blended", expr)


def best_per_cluster(blended: DataFrame, seed: int = 42, score: str = "blended") -> DataFrame:
    """T5: the best document of each cluster; exact ties broken by a seeded hash of the docid.

    ``max_by`` is a partial aggregation, so a cluster of any size costs one row per partition.
    """
    key = F.struct(F.col(score), F.xxhash64(F.lit(seed), F.col("docid")).alias("h"), F.col("docid"))
    return (blended.groupBy("cid").agg(F.max_by(F.struct("docid", score), key).alias("b"))
                   .select("cid", "b.docid", F.col(f"b.{score}").alias(score)))


def cluster_quota(sizes: DataFrame, total: int, align_to_k: bool = False) -> DataFrame:
    """Q2: quota per cluster: 1 when aligned to K, else ceil(total * size / N)."""
    if align_to_k:
        return sizes.withColumn("quota", F.lit(1).cast("bigint"))
    n = sizes.agg(F.sum("size")).first()[0]
    return sizes.withColumn("quota", F.ceil(F.lit(float(total)) * F.col("size") / F.lit(float(n))).cast("bigint"))


def cluster_schedule(quotas: DataFrame, total: int) -> DataFrame:
    """Order in which clusters are served, in closed form.

    Serving always the cluster with the smallest selected/quota (ties: lowest cid) equals sorting
    the slots (cid, j) for j < quota by (j / quota, cid) and keeping the first ``total``.
    The slot table has sum(quota) ~ total rows: question-sized, never document-sized.
    """
    slots = quotas.where(F.col("quota") > 0).select(
        "cid", "quota", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)).alias("j"))
    w = Window.orderBy(F.col("j") / F.col("quota"), F.col("cid"))
    return (slots.withColumn("step", F.row_number().over(w).cast("bigint"))
                 .where(F.col("step") <= total).select("step", "cid", F.col("j").alias("visit")))
