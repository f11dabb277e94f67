"""Expert-weight policy: advantage rules and the weight update (M14, M15, M16, W8), A19, A20.

The update is sequential in the step order, but its state is four weights plus a baseline or a
linear critic.  The step log streams through it in order; the log has one row per generated question
(the run's target count), not per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irforge.functions import fixed

N_EXPERTS = 4


def _normed(w: list[float]) -> list[float]:
    """Weights of sum 1; a zero vector (no floor) falls back to uniform."""
    total = sum(w)
    return [x / total for x in w] if total > 0 else [1.0 / N_EXPERTS] * N_EXPERTS


def weight_fold(log: DataFrame, total: int, advantage: str = "ema", eta: float = fixed.ETA,
                hard_match: bool = True, lambda_hard: float = fixed.LAMBDA_HARD,
                warmup: float = fixed.HARD_WARMUP_RATIO, use_floor: bool = True, w_floor: float = fixed.W_FLOOR,
                use_entropy: bool = True, entropy: float = fixed.ENTROPY, beta: float = fixed.BASELINE_BETA,
                critic_lr: float = fixed.CRITIC_LR, start: dict | None = None, keep_state: bool = False) -> DataFrame:
    """Replay the weight updates over ``log``: (step 1.., s array<double>[4], r array<double>[4], score).

    advantage: "ema" (score - previous EMA baseline, then b <- (1-beta) b + beta score),
    "critic" (score - (c.s + c0), then c += lr adv s, c0 += lr adv) or "raw" (the score).
    grad = (1 - a)(s - mean s) + a (r - mean r) with a = lambda_hard during the warm-up share of
    steps; w <- max(0, w + eta adv grad), floor, renormalise, mix with uniform, renormalise.
    Returns one row per step: step, w1..w4 (after the update), advantage, baseline; with ``keep_state``
    also the state after the step, from which a later call continues (``start``).

    A step needs the weights of the step before, so the log, one row per generated question, is read once in
    its order; the state is nine numbers and the work linear in the log.
    """
    first = start or start_state()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, cw, cb = list(first["w"]), first["b"], list(first["cw"]), first["cb"]
        for rows in batches:
            out = []
            for at, s, r, score in zip(rows["step"].tolist(), rows["s"].tolist(), rows["r"].tolist(), rows["score"].tolist()):
                s, r = [float(x) for x in s], [float(x) for x in r]
                if advantage == "critic":
                    logged = sum(c * x for c, x in zip(cw, s)) + cb
                    adv = score - logged
                    cw, cb = [c + critic_lr * adv * x for c, x in zip(cw, s)], cb + critic_lr * adv
                elif advantage == "ema":
                    adv = score - b
                    b = logged = (1.0 - beta) * b + beta * score
                else:
                    adv, logged = score, b
                alpha = lambda_hard if hard_match and at / total <= warmup else 0.0
                s_mean, r_mean = sum(s) / N_EXPERTS, sum(r) / N_EXPERTS
                w = [max(x + eta * adv * ((1.0 - alpha) * (y - s_mean) + alpha * (z - r_mean)), 0.0) for x, y, z in zip(w, s, r)]
                w = _normed([max(x, w_floor) for x in w] if use_floor else w)
                if use_entropy:
                    w = _normed([(1.0 - entropy) * x + entropy / N_EXPERTS for x in w])
                out.append((at, *w, adv, logged, b, cw, cb))
            yield pd.DataFrame(out, columns=["step", "w1", "w2", "w3", "w4", "advantage", "baseline", "b", "cw", "cb"])

    rows = log.select(F.col("step").cast("long").alias("step"), "s", "r", F.col("score").cast("double").alias("score")).repartition(1).sortWithinPartitions("step", "s", "r", "score")
    out = rows.mapInPandas(fold, "step long, w1 double, w2 double, w3 double, w4 double, advantage double, baseline double, b double, cw array<double>, cb double")
    return out.select("step", "w1", "w2", "w3", "w4", "advantage", "baseline", *([F.struct("b", "cw", "cb").alias("state")] if keep_state else []))


def start_state(weights: list[float] = fixed.INIT_WEIGHTS) -> dict:
    """Weights, baseline and critic before the first step."""
    return {"w": list(weights), "b": 0.0, "cw": [0.0] * N_EXPERTS, "cb": 0.0}


def reward_curve(log: DataFrame, bucket: int = 10) -> DataFrame:
    """Per bucket of ``bucket`` steps the mean rewards, score, advantage and baseline."""
    b = F.floor((F.col("step") - 1) / bucket).cast("bigint")
    return log.groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_steps"),
        *[F.avg(F.col("r")[i]).alias(f"mean_r{i + 1}") for i in range(N_EXPERTS)],
        F.avg("score").alias("mean_score"), F.avg("advantage").alias("mean_advantage"),
        F.avg("baseline").alias("mean_baseline"))


def run_stats(assign: DataFrame, k: int, generated_requested: int, generated_produced: DataFrame | None = None) -> DataFrame:
    """K, documents, requested (and produced) question counts, cluster sizes by cid."""
    sizes = (assign.sparkSession.range(k).select(F.col("id").cast("int").alias("cid"))
             .join(assign.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid", "left")
             .select("cid", F.coalesce("n", F.lit(0)).alias("n")))
    agg = sizes.agg(F.sum("n").cast("bigint").alias("num_docs"),
                    F.transform(F.sort_array(F.collect_list(F.struct("cid", "n"))), lambda e: e["n"]).alias("cluster_sizes"))
    out = agg.select(F.lit(k).alias("K"), "num_docs", F.lit(generated_requested).cast("bigint").alias("generated"), "cluster_sizes")
    if generated_produced is not None:
        out = out.withColumn("produced", F.lit(generated_produced.count()).cast("bigint"))
    return out
