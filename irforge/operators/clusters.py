"""Cluster statistics and model-shaped cluster operators.

Cluster-level tables (centroids, sizes, curves) have one row per cluster or per K and are small by
construction; per-document work is a projection, a partial aggregation, or a blocked join.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irforge.functions.vectors import cosine, with_unit
from irforge.operators import joint_kmeans as joint
from irforge.operators import similarity as sim
from irforge.operators.common import bounded_broadcast, with_position
from irforge.session import materialize
from irforge.sources.sinks import append_step_log


def cluster_sizes(assign: DataFrame, k: int | None = None, cid: str = "cid") -> DataFrame:
    """A1: (cid, size) with empty clusters 0..k-1 filled in when ``k`` is given."""
    sizes = assign.groupBy(cid).agg(F.count(F.lit(1)).alias("size"))
    if k is None:
        return sizes
    spark = assign.sparkSession
    allc = spark.range(k).select(F.col("id").cast("int").alias(cid))
    return allc.join(sizes, cid, "left").select(cid, F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def cluster_means(assign: DataFrame, vec: str = "vec", cid: str = "cid", normalize: bool = True) -> DataFrame:
    """A2: mean vector per cluster (vector aggregation in the JVM, map-side combined),
    optionally re-normalised to unit length."""
    m = (assign.groupBy(cid).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m"))
               .select(cid, vector_to_array("m").alias("center")))
    return with_unit(m, "center", "center").select(cid, "center") if normalize else m


def nearest_centroid(docs: DataFrame, centers: DataFrame, vec: str = "vec", id_col: str = "docid",
                     cid: str = "cid") -> DataFrame:
    """(docid, cid, dist) nearest centre by Euclidean distance (ties by smaller cid)."""
    t = sim.topk(docs, centers.select(F.format_string("%010d", F.col(cid)).alias("__c"), F.col("center")), 1, metric="l2",
                 left_id=id_col, right_id="__c", left_vec=vec, right_vec="center")
    return t.select(F.col("lid").alias(id_col), F.col("rid").cast("int").alias(cid), F.col("score").alias("dist"))


def medoid_per_cluster(docs: DataFrame, centers: DataFrame, vec: str = "vec", id_col: str = "docid",
                       cid: str = "cid") -> DataFrame:
    """(cid, docid, dist) the corpus document nearest to each centre (any cluster)."""
    t = sim.topk(centers.select(F.format_string("%010d", F.col(cid)).alias("__c"), "center"), docs, 1, metric="l2",
                 left_id="__c", right_id=id_col, left_vec="center", right_vec=vec)
    return t.select(F.col("lid").cast("int").alias(cid), F.col("rid").alias(id_col), F.col("score").alias("dist"))


def nearest_cluster(centers: DataFrame, cid: str = "cid") -> DataFrame:
    """(cid, near_cid, sim) the other cluster whose (unit) centre has the highest cosine."""
    c = centers.select(F.format_string("%010d", F.col(cid)).alias("__c"), "center")
    t = sim.topk(c, c, 1, left_id="__c", right_id="__c", left_vec="center", right_vec="center", exclude_self=True)
    return t.select(F.col("lid").cast("int").alias(cid), F.col("rid").cast("int").alias("near_cid"), F.col("score").alias("sim"))


def cosine_sse(assign: DataFrame, centers: DataFrame, vec: str = "vec", cid: str = "cid") -> DataFrame:
    """A3: Σ (1 - cos(doc, its centre))^2 as one row; centres are broadcast after a size check."""
    j = assign.join(bounded_broadcast(centers.select(cid, "center"), 100_000), cid)
    return j.agg(F.sum(F.pow(1.0 - cosine(F.col(vec), F.col("center")), 2)).alias("sse"))


def doc_center_cosine(assign: DataFrame, centers: DataFrame, vec: str = "vec", cid: str = "cid") -> DataFrame:
    """Cosine of each document to its own centre (input of W1)."""
    j = assign.join(bounded_broadcast(centers.select(cid, "center"), 100_000), cid)
    return j.withColumn("cos", cosine(F.col(vec), F.col("center")))


def kmeans_fit(df: DataFrame, k: int, seed: int, max_iter: int = 100, vec: str = "vec", n_init: int = 1):
    """M1: MLlib k-means (k-means|| init); best of ``n_init`` seeds by training cost.

    k-means|| may return fewer than k centres on degenerate data; callers read the model's centres.
    """
    feats = df.select("*", array_to_vector(F.col(vec)).alias("__features"))
    best = None
    for i in range(n_init):
        model = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="__features", predictionCol="cid").fit(feats)
        cost = model.summary.trainingCost
        if best is None or cost < best[1]:
            best = (model, cost)
    return best[0]


def kmeans_assign(df: DataFrame, model, vec: str = "vec") -> DataFrame:
    feats = df.select("*", array_to_vector(F.col(vec)).alias("__features"))
    return model.transform(feats).drop("__features").withColumn("cid", F.col("cid").cast("int"))


def model_centers(spark, model) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cid int, center array<double>")


def silhouette(sample: DataFrame, vec: str = "vec", id_col: str = "docid", cid: str = "cid") -> DataFrame:
    """Mean Euclidean silhouette of an assignment (one row).

    a(i) = mean distance to the other members of its cluster, b(i) = smallest mean distance to
    another cluster, s = (b - a)/max(a, b), 0 for singletons.  The blocked kernel returns a and b,
    never the pairs themselves nor a row for each document and cluster.
    """
    sizes = sample.groupBy(F.col(cid).alias("lcid")).agg(F.count(F.lit(1)).alias("size"))
    ab = sim.cluster_distances(sample, id_col=id_col, vec=vec, cid=cid).join(sizes, "lcid")
    s = F.when(F.col("size") <= 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest(F.col("a"), F.col("b"))), F.lit(0.0)))
    return ab.agg(F.avg(s).alias("silhouette"))


def candidate_k_grid(n: int) -> list[int]:
    """sorted distinct {sqrt N, N//80, N//60, N//40, N//20}, each >= 8, kept when k < N."""
    ks = sorted({max(8, int(math.sqrt(n))), max(8, n // 80), max(8, n // 60), max(8, n // 40), max(8, n // 20)})
    return [k for k in ks if k < n]


def uniform_sample(df: DataFrame, n: int, seed: int, id_col: str = "docid") -> DataFrame:
    """Q4: n rows without replacement, chosen by a seeded hash of the id (layout independent).

    The rows come from positions in that order, so no task holds the whole sample."""
    keyed = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_col)))
    return with_position(keyed, "_hash", id_col, out="_place").where(F.col("_place") < n).drop("_hash", "_place")


def auto_select_k(df: DataFrame, seed: int = 42, sample_n: int = 5000, vec: str = "vec", id_col: str = "docid",
                  n_init: int = 10, max_iter: int = 300):
    """M2: fit each K of the grid on a seeded sample, keep the highest silhouette (first on ties).

    The sample has at least ``sample_n`` rows and four times the largest K, so no candidate is lost on
    a large collection.  Every K has ``n_init`` starts (``joint_kmeans``), and the cheapest model counts.
    Returns (best_k, curve DataFrame(k, silhouette))."""
    n = df.count()
    ks = candidate_k_grid(n)
    if not ks:
        raise ValueError("empty K grid: need more than 8 documents")
    sample = uniform_sample(df, min(max(sample_n, 4 * max(ks)), n), seed, id_col).select(id_col, vec)
    # every pass below reads it: as many files as there are cores, so that all take part
    sample = materialize(sample.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism)))
    models = joint.fit(sample, [(k, i) for k in ks for i in range(n_init)], seed, max_iter=max_iter, vec=vec, id_col=id_col, spread=True, best=True)
    rows = []
    for k, model in zip(ks, models):
        assigned = materialize(sample.withColumn("cid", joint.cell_of(sample, model, vec)))
        sc = silhouette(assigned, vec, id_col).first()["silhouette"]
        rows.append((k, -1.0 if sc is None else float(sc)))
    best = max(rows, key=lambda r: (r[1], -ks.index(r[0])))[0]
    return best, df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def sse_curve(df: DataFrame, k_list: list[int], seed: int, max_iter: int = 100, vec: str = "vec",
              id_col: str = "docid", path: str | None = None) -> DataFrame:
    """M3: (k, sse) cosine SSE for each K < N (skipped otherwise), all K fitted in the same passes.

    With ``path``, a K's row is appended there as soon as its model is done (K15), so a partial run leaves its part of
    the curve."""
    spark = df.sparkSession
    n = df.count()
    rows = []

    def done(models: list[joint.Fitted]) -> None:
        new = [(m.k, sse) for m, sse in zip(models, joint.cosine_sse(df, models, vec))]
        rows.extend(new)
        if path:
            append_step_log(spark.createDataFrame(new, "k int, sse double").coalesce(1), path)

    joint.fit(df, [(k, 0) for k in k_list if k < n], seed, max_iter=max_iter, vec=vec, id_col=id_col, on_done=done)
    return spark.createDataFrame(sorted(rows), "k int, sse double")


def knee_point(curve: DataFrame, x: str = "k", y: str = "sse", S: float = 0.01,
               increment: int = 0, decrement: int = 0) -> DataFrame:
    """M4: Kneedle knee (Satopaa et al. 2011; offline, convex, decreasing) of a small curve table.

    x and y are min-max normalised; the difference curve is d = (1 - y_n) - x_n; local maxima and
    minima of d use >= / <= with clipped ends; the threshold after a maximum at t is
    d_t - S * |mean diff x_n|, after a minimum it is 0; the knee is x at the last maximum before the
    first point whose successor falls below the threshold.  One row (knee, null if none) — the
    windows run over one row per K, never over documents.
    """
    w = Window.orderBy("x")
    wall = Window.partitionBy()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = (curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
              .withColumn("i", F.row_number().over(w) - 1)
              .withColumn("n", F.count(F.lit(1)).over(wall))
              .withColumn("xn", F.try_divide(F.col("x") - F.min("x").over(wall), F.max("x").over(wall) - F.min("x").over(wall)))
              .withColumn("yn", F.try_divide(F.col("y") - F.min("y").over(wall), F.max("y").over(wall) - F.min("y").over(wall))))
    c = c.withColumn("d", (F.max("yn").over(wall) - F.col("yn")) - F.col("xn"))
    prev_d = F.coalesce(F.lag("d").over(w), F.col("d"))
    next_d = F.coalesce(F.lead("d").over(w), F.col("d"))
    c = (c.withColumn("is_max", (F.col("d") >= prev_d) & (F.col("d") >= next_d))
          .withColumn("is_min", (F.col("d") <= prev_d) & (F.col("d") <= next_d))
          .withColumn("d_next", F.lead("d").over(w)))
    c = (c.withColumn("last_max", F.max(F.when(F.col("is_max"), F.col("i"))).over(run))
          .withColumn("last_min", F.max(F.when(F.col("is_min"), F.col("i"))).over(run)))
    tmx = F.col("d") - F.lit(S) / (F.col("n") - 1)
    c = c.withColumn("tmx", F.when(F.col("is_max"), tmx))
    c = c.withColumn("thr_at_max", F.last("tmx", ignorenulls=True).over(run))
    c = c.withColumn("x_at_max", F.last(F.when(F.col("is_max"), F.col("x")), ignorenulls=True).over(run))
    thr = F.when(F.col("last_min") >= F.col("last_max"), F.lit(0.0)).otherwise(F.col("thr_at_max"))
    hits = c.where(F.col("last_max").isNotNull() & F.col("d_next").isNotNull() & (F.col("d_next") < thr))
    first = hits.agg(F.min_by("x_at_max", "i").alias("knee"))
    return first.select((F.col("knee") + F.lit(increment - decrement)).cast("double").alias("knee"))
