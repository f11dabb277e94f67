"""Offline replay of the question-selection loop over a deterministic step table
(T6 + T5 + M8-M11 + W7 + J14 + M14-M16 + A19 + A20), and its driver-free pieces.

Step table (FIXTURES §3): the cluster schedule of T6 over label quotas; at each step the best
document of the cluster under the initial weights (T5); reward vector = |unit vector elements 1-4|,
expert vector = elements 5-8, score = mean reward; the accepted question of a step is the question
embedding of its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.operators import clusters as C
from irforge.operators import experts as X
from irforge.operators import policy as P
from irforge.operators import rewards as RW
from irforge.plans import feature_plans as fp
from irforge.session import materialize
from irforge.sources import tables as T

R = 6
TOTAL = fp.TARGET_QUESTIONS
THRESHOLD = 0.30
N_CANDS = fixed.N_CANDS


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.docs_with_embeddings(spark, sf_dir).select("docid", "vec", "cid")


def steps(spark: SparkSession, sf_dir: str, total: int = TOTAL) -> DataFrame:
    sched = fp.cluster_schedule(spark, sf_dir, total)
    b = fp._blended(spark, sf_dir).withColumn("blended", F.round("blended", 9))
    best = X.best_per_cluster(b).select("cid", "docid")
    u = T.unit_embeddings(spark, sf_dir).select("docid", "vec")
    q = T.shifted_unit_embeddings(spark, sf_dir, 7, 1)
    s = sched.join(best, "cid").join(u, "docid").join(q, "docid")
    # question-sized and read by every reward below: written once
    return materialize(s.select("step", "cid", "docid", "qvec",
                                F.transform(F.slice("vec", 1, 4), lambda x: F.abs(x)).alias("r"),
                                F.slice("vec", 5, 4).alias("s")))


def _log(spark, sf_dir):
    st = steps(spark, sf_dir)
    return st.withColumn("score", F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / 4.0)


def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("step", "cid", "docid", F.round("score", R).alias("score"))


def _policy(spark, sf_dir, advantage):
    w = P.weight_fold(_log(spark, sf_dir), TOTAL, advantage=advantage)
    return w.select("step", *[F.round(f"w{i}", R).alias(f"w{i}") for i in range(1, 5)],
                    F.round("advantage", R).alias("advantage"), F.round("baseline", R).alias("baseline"))


def policy_replay_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "ema")


def policy_replay_critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "critic")


def reward_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    w = P.weight_fold(log, TOTAL, advantage="ema")
    c = P.reward_curve(log.join(w.select("step", "advantage", "baseline"), "step"))
    return c.select("bucket", "n_steps", *[F.round(x, R).alias(x) for x in c.columns if x.startswith("mean_")])


def rank_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = RW.rank_reward(steps(spark, sf_dir), corpus(spark, sf_dir))
    return r.select("step", "docid", "rank", F.round("r1", R).alias("r1"))


def discriminative_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    cor = corpus(spark, sf_dir)
    near = C.nearest_cluster(C.cluster_means(cor)).select("cid", "near_cid")
    r = RW.discriminative_reward(steps(spark, sf_dir), cor, near)
    return r.select("step", "docid", *[F.round(c, R).alias(c) for c in ("cos_qp", "cos_same", "cos_near", "r2")])


def answer_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = T.shifted_unit_embeddings(spark, sf_dir, 11, 3, name="avec")
    r = RW.answer_reward(steps(spark, sf_dir), corpus(spark, sf_dir), answers)
    return r.select("step", "docid", F.round("r3", R).alias("r3"))


def coverage_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = RW.coverage_reward(steps(spark, sf_dir), corpus(spark, sf_dir), THRESHOLD)
    return r.select("step", "docid", "global_new", "add_c", F.round("r4", R).alias("r4"))


def candidates(spark: SparkSession, sf_dir: str, n_cands: int = N_CANDS) -> DataFrame:
    """(cid_key, step, cand, seq, qvec, accepted): candidate c of a step's document d is
    unit(emb[d] + emb[(7d + 1 + 13c) mod n]); candidate 0 is the accepted question."""
    st = steps(spark, sf_dir).select("step", "docid")
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.count()
    c = (st.select("step", "docid", F.explode(F.sequence(F.lit(0), F.lit(n_cands - 1))).alias("cand"))
           .withColumn("partner", F.pmod(F.col("docid").cast("bigint") * 7 + 1 + F.col("cand") * 13, F.lit(n))))
    from irforge.functions.vectors import add, with_unit
    j = (c.join(e.select(F.col("vec_id").cast("string").alias("docid"), F.col("v").alias("dv")), "docid")
          .join(e.select(F.col("vec_id").alias("partner"), F.col("v").alias("pv")), "partner"))
    j = with_unit(j.withColumn("s", add("dv", "pv")), "s", "qvec")
    return j.select(F.concat_ws(":", F.col("step").cast("string"), F.col("cand").cast("string")).alias("cid_key"),
                    "step", "cand", ((F.col("step") - 1) * n_cands + F.col("cand")).alias("seq"), "qvec",
                    (F.col("cand") == 0).alias("accepted"))


def dynamic_dup_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + J14 + M13 decision per candidate: max cosine to the accepted bank of earlier steps,
    the dynamic threshold from all earlier values, and the duplicate flag."""
    return dup_decisions(candidates(spark, sf_dir))


def dup_decisions(cands: DataFrame) -> DataFrame:
    """The same for given candidates."""
    bank = RW.bank_max_similarity(cands)
    hist = cands.join(bank, "cid_key").select("step", "cand", "seq", F.col("bank_max").alias("value"))
    d = RW.dynamic_threshold(hist.withColumn("value", F.round("value", 9)))
    return d.select("step", "cand", F.round("value", R).alias("value"), F.round("threshold", R).alias("threshold"), "is_dup")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cor = corpus(spark, sf_dir)
    k = cor.agg(F.max("cid")).first()[0] + 1
    s = P.run_stats(cor, k, TOTAL, replay_steps(spark, sf_dir))
    return s.select("K", "num_docs", "generated", "produced",
                    F.array_join(F.transform("cluster_sizes", lambda x: x.cast("string")), ",").alias("cluster_sizes"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 rows of the replay: step, weights, reward, cid, doc_idx, best_score, advantage, baseline."""
    log = _log(spark, sf_dir)
    w = P.weight_fold(log, TOTAL, advantage="ema")
    return (log.join(w, "step")
               .select("step", F.array("w1", "w2", "w3", "w4").alias("weights"), F.col("r").alias("reward"), "cid",
                       F.col("docid").alias("doc_idx"), F.col("score").alias("best_score"), "advantage", "baseline"))


def stream_progress(spark: SparkSession, sf_dir: str, rounds: int = 5) -> DataFrame:
    """ST1: the replay's step log is appended in ``rounds`` files (as a running job would), then a
    streaming aggregate processes the folder; its final state is returned as a DataFrame."""
    import uuid

    from irforge.session import ensure_checkpoint_dir, materialize
    from irforge.sources.sinks import append_step_log
    from irforge.streaming.progress import start_progress_stream

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/irforge-stream/{uuid.uuid4().hex}"
    log = materialize(step_log(spark, sf_dir))
    per = max(1, -(-TOTAL // rounds))
    for i in range(rounds):
        append_step_log(log.where((F.col("step") > i * per) & (F.col("step") <= (i + 1) * per)).coalesce(1), f"{base}/log")
    name = "progress_" + uuid.uuid4().hex[:8]
    q = start_progress_stream(spark, f"{base}/log", f"{base}/ckpt", name)
    q.awaitTermination()
    out = spark.table(name)
    return out.select("cid", "n_steps", F.round("mean_score", R).alias("mean_score"),
                      F.round("mean_advantage", R).alias("mean_advantage"), "last_step")


DEDUP_TEST_TAU = 0.5  # the reference's 0.90 finds no pairs among these derived embeddings


def question_dup_edges(spark: SparkSession, sf_dir: str, tau: float = DEDUP_TEST_TAU) -> DataFrame:
    """M13 edge list: (later, earlier, cos) for candidate pairs with cosine >= tau."""
    from irforge.operators import similarity as sim
    c = candidates(spark, sf_dir)
    e = sim.block_join(c, c, "edges_ge", threshold=tau, left_id="cid_key", right_id="cid_key", left_vec="qvec",
                       right_vec="qvec", left_cols={"lorder": "seq"}, right_cols={"rorder": "seq"})
    return e.select(F.col("lid").alias("later"), F.col("rid").alias("earlier"), F.round("score", R).alias("cos"))


def semantic_dedup(spark: SparkSession, sf_dir: str, tau: float = DEDUP_TEST_TAU) -> DataFrame:
    """M13 (rows-only): greedy first-wins acceptance of every candidate question."""
    return RW.semantic_dedup(candidates(spark, sf_dir), tau)


def sorted_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct documents chosen during the run, in document order (question-sized)."""
    from pyspark.sql import Window
    chosen = steps(spark, sf_dir).select("docid").distinct()
    w = Window.orderBy(F.col("docid").cast("bigint"))
    return chosen.select("docid", F.row_number().over(w).cast("bigint").alias("ord"))
