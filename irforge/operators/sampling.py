"""Representative-document sampling.

Cluster-level tables are small (one row per cluster); per-document work is projections and
partitioned windows; the greedy MMR runs per cluster over a pool bounded by 5 x sample size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irforge.functions import fixed

# Buckets in which the first phase of a per-cluster top-n runs.
SPLIT = 16


def sample_sizes(sizes: DataFrame, n_train: int, compat_topup: bool = False) -> DataFrame:
    """Q1 + W5: 1 + floor((n_train - n_clusters) * size / N) per cluster, then +1 for the
    ``n_remaining`` largest clusters (ties: larger cid first, as a stable ascending sort read from
    the end).  n_remaining = 0 tops up none (compat_topup=True reproduces Python's ``[-0:]``, which
    tops up every cluster).  Sizes are clamped to [0, cluster size].
    """
    agg = sizes.agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("n")).first()
    k, n = int(agg["k"]), int(agg["n"])
    base = sizes.withColumn("sample_size", (1 + F.floor(F.lit(float(n_train - k)) * F.col("size") / F.lit(float(n)))).cast("bigint"))
    total = base.agg(F.sum("sample_size")).first()[0]
    remaining = n_train - int(total)
    if n_train != k:
        w = Window.orderBy(F.desc("size"), F.desc("cid"))
        ranked = base.withColumn("__r", F.row_number().over(w))
        if remaining > 0:
            top = F.col("__r") <= remaining
        elif remaining == 0 and compat_topup:
            top = F.lit(True)
        elif remaining < 0:  # Python's [-m:] with m < 0 keeps all but the first |m| (ascending order)
            top = F.col("__r") <= k + remaining
        else:
            top = F.lit(False)
        base = ranked.withColumn("sample_size", F.col("sample_size") + F.when(top, 1).otherwise(0)).drop("__r")
    return base.withColumn("sample_size", F.least(F.greatest(F.col("sample_size"), F.lit(0)), F.col("size")).cast("bigint"))


def cluster_softmax(scored: DataFrame, score: str = "cos", temperature: float = fixed.SOFTMAX_TEMPERATURE) -> DataFrame:
    """exp(x/T) / Σ exp(x/T) within each cluster (max-shifted for stability); the maximum and the
    sum are aggregations per cluster, joined back."""
    z = F.col(score) / temperature
    shifted = scored.join(scored.groupBy("cid").agg(F.max(z).alias("__top")), "cid").withColumn("__e", F.exp(z - F.col("__top")))
    total = shifted.groupBy("cid").agg(F.sum("__e").alias("__sum"))
    return shifted.join(total, "cid").select(*scored.columns, (F.col("__e") / F.col("__sum")).alias("p"))


def weighted_sample(probs: DataFrame, sizes: DataFrame, seeds: list[int] = fixed.SAMPLING_SEEDS,
                    id_col: str = "docid") -> DataFrame:
    """Q3 + U1: per cluster and seed, ``sample_size`` documents without replacement with
    probability weights p (Efraimidis-Spirakis keys ln(u)/p, largest first); the pool is the
    distinct union over seeds.  Same distribution as sequential weighted draws, different draws.

    All seeds are drawn in one pass.  The top-n has two phases, first within (cluster, seed, id
    hash bucket), then over the buckets' survivors, so a large cluster is not sorted in one task.
    """
    h = F.pmod(F.xxhash64("__seed", F.col(id_col)), F.lit(1 << 52)).cast("double")
    drawn = (probs.join(sizes.select("cid", "sample_size"), "cid")
                  .select("cid", id_col, "p", "sample_size", F.explode(F.array(*map(F.lit, seeds))).alias("__seed"))
                  .withColumn("__key", F.log((h + 0.5) / float(1 << 52)) / F.col("p"))
                  .withColumn("__bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SPLIT))))
    order = [F.desc("__key"), F.asc(id_col)]
    for group in (["cid", "__seed", "__bucket"], ["cid", "__seed"]):
        drawn = drawn.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= F.col("sample_size"))
    return drawn.select("cid", id_col).distinct()


def mmr_order(sim_seed: np.ndarray, sim_pair: np.ndarray, ids: np.ndarray, lam: float) -> list[tuple[str, float, int]]:
    """Greedy MMR: repeatedly take argmax of lam*sim_seed(x) - (1-lam)*max_{y chosen, y != x} sim(x, y)
    (0 before anything is chosen); every member is ordered and keeps the score it had when chosen.
    Ties go to the smallest id."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ids, sim_seed, sim_pair = ids[order], sim_seed[order], sim_pair[np.ix_(order, order)]
    chosen = np.zeros(n, dtype=bool)
    red = np.full(n, -np.inf)
    out = []
    for step in range(n):
        pen = np.where(np.isfinite(red), red, 0.0)
        score = lam * sim_seed - (1.0 - lam) * pen
        score = np.where(chosen, -np.inf, score)
        i = int(np.argmax(score))
        out.append((str(ids[i]), float(score[i]), step))
        chosen[i] = True
        red = np.maximum(red, np.where(np.arange(n) == i, -np.inf, sim_pair[:, i]))
    return out


def mmr_select(pool: DataFrame, seeds: DataFrame, sizes: DataFrame, lam: float = 1.0, id_col: str = "docid",
               vec: str = "vec") -> DataFrame:
    """M5 + T4: order each cluster's pool by greedy MMR against the cluster's seed document, then keep
    the ``sample_size`` members with the highest recorded score.

    ``pool``: (cid, docid, vec); ``seeds``: (cid, seed_vec); one group = one cluster's pool, bounded
    by len(seeds) * sample_size rows.
    """
    g = pool.join(seeds, "cid").join(sizes.select("cid", "sample_size"), "cid")

    def per_cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
        s = np.asarray(pdf["seed_vec"].iloc[0], dtype=np.float64)
        nx = np.maximum(np.linalg.norm(X, axis=1), 1e-12)  # a zero vector has similarity 0 to all
        sim_seed = X @ s / (nx * max(np.linalg.norm(s), 1e-12))
        sim_pair = (X @ X.T) / np.outer(nx, nx)
        res = mmr_order(sim_seed, sim_pair, pdf[id_col].astype(str).to_numpy(), lam)
        df = pd.DataFrame(res, columns=[id_col, "mmr_score", "mmr_step"])
        df["cid"] = int(pdf["cid"].iloc[0])
        n = int(pdf["sample_size"].iloc[0])
        df = df.sort_values(["mmr_score", id_col], ascending=[False, True]).head(n)
        return df[["cid", id_col, "mmr_score", "mmr_step"]]

    return g.groupBy("cid").applyInPandas(per_cluster, f"cid int, {id_col} string, mmr_score double, mmr_step long")


def exemplar_sample(docs: DataFrame, weights: DataFrame, k: int = 3, seed: int = 0, id_col: str = "docid",
                    text_col: str = "doctext", max_iter: int = 20) -> DataFrame:
    """Q5: few-shot exemplars — k-means (k = min(3, N)) on the TF-IDF rows, one seeded-random member
    per lexical cluster, its passage prefix (600 chars) and a template question from its 5 heaviest
    terms of at most 3 words; padded to ``k`` rows with the fixed padding pair.  (i, passage, query)

    The sparse TF-IDF rows are assembled by a small per-row helper (array -> SparseVector); the
    clustering itself is MLlib's distributed k-means.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import SparseVector, VectorUDT

    from irforge.operators.lexical import top_terms
    from irforge.operators.textprep import question_from_terms, text_prefix

    spark = docs.sparkSession
    vocab = weights.select("term").distinct()
    from irforge.session import materialize
    # written once: re-running zipWithIndex over an unordered distinct could renumber the terms
    v_idx = materialize(vocab.rdd.zipWithIndex().map(lambda p: (p[0][0], int(p[1]))).toDF(["term", "idx"]))
    dim = v_idx.count()
    rows = (weights.join(v_idx, "term").groupBy(id_col)
                   .agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("entries")))
    to_vec = F.udf(lambda es: SparseVector(dim, [e["idx"] for e in es], [e["w"] for e in es]), VectorUDT())
    feats = rows.select(id_col, to_vec("entries").alias("features"))
    n = feats.count()
    kk = min(k, max(1, n))
    model = KMeans(k=kk, seed=seed, maxIter=max_iter).fit(feats)
    assign = model.transform(feats).select(id_col, F.col("prediction").alias("lc"))
    pick = assign.groupBy("lc").agg(F.min_by(id_col, F.xxhash64(F.lit(seed), F.col(id_col))).alias(id_col))
    terms = (top_terms(weights, 5, id_col, max_words=3).groupBy(id_col)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("term_rank", "term"))), lambda s: s["term"]).alias("terms")))
    shots = (pick.join(docs.select(id_col, text_col), id_col).join(terms, id_col, "left")
                 .select(F.col("lc").alias("i"), text_prefix(F.col(text_col), fixed.EXEMPLAR_CHARS).alias("passage"),
                         question_from_terms(F.coalesce("terms", F.array().cast("array<string>"))).alias("query")))
    have = shots.count()
    if have < k:
        pad = spark.createDataFrame([(kk + j, *fixed.PAD_EXEMPLAR) for j in range(k - have)], "i int, passage string, query string")
        shots = shots.unionByName(pad)
    w = Window.orderBy("i")
    return shots.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k)
