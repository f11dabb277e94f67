"""Candidate-question rewards over a table of steps.

A *steps* table has one row per generation step: (step, cid, docid, qvec) — the scheduled cluster,
the chosen source document and the accepted question's unit embedding.  The corpus is
(docid, vec, cid) with unit vectors.  Every reward is a join/aggregate over these tables; the only
similarity work goes through the blocked kernels (no step-by-step jobs, no all-pairs rows).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from irforge.functions import fixed
from irforge.functions.vectors import dot
from irforge.operators import similarity as sim


def rank_reward(steps: DataFrame, corpus: DataFrame, topk: int = 100, tau: float = fixed.R1_TAU) -> DataFrame:
    """W4 + M8: rank of the source document among all documents for its question (ties: smaller
    docid first), topk + 1 when outside the top-k; r1 = exp(-(rank - 1) / tau)."""
    own = (steps.join(corpus.select("docid", F.col("vec").alias("pvec")), "docid")
                .select("step", "docid", "qvec", dot("qvec", "pvec").alias("own")))
    cnt = sim.rank_counts(own.withColumn("sid", F.col("step").cast("string")), corpus, left_id="sid", left_vec="qvec",
                          right_vec="vec", left_cols={"lthr": "own", "lexcl": "docid"})
    r = own.join(cnt.select(F.col("lid").cast("bigint").alias("step"), "cnt"), "step", "left")
    rank = F.coalesce(F.col("cnt"), F.lit(0)) + 1
    rank = F.when(rank <= topk, rank).otherwise(F.lit(topk + 1))
    return r.select("step", "docid", rank.cast("bigint").alias("rank"), F.exp(-(rank - 1) / tau).alias("r1"))


def discriminative_reward(steps: DataFrame, corpus: DataFrame, near: DataFrame) -> DataFrame:
    """J11 + M9: hardest document of the own cluster (other than the source) and of the nearest
    other cluster; an empty pool falls back to the source document; r2 = cos(q,p)(1-cos_same)(1-cos_near).

    A cluster without another one (a single cluster) is its own nearest cluster, and that pool holds
    the source document too.

    ``near``: (cid, near_cid) from J12.  The blocked kernel returns only the best match per
    (step, allowed cluster), never the pairs.
    """
    st = (steps.join(near, "cid", "left").withColumn("near_cid", F.coalesce("near_cid", "cid"))
               .join(corpus.select("docid", F.col("vec").alias("pvec")), "docid")
               .withColumn("sid", F.col("step").cast("string"))
               .withColumn("groups", F.array(F.col("cid"), F.col("near_cid"))))
    best = sim.group_best(st, corpus, left_id="sid", left_vec="qvec", right_vec="vec",
                          left_cols={"lgroups": "groups", "lexcl": "docid"}, right_cols={"rgroup": "cid"})
    b = best.select(F.col("lid").cast("bigint").alias("step"), "rgroup", "score")
    same = b.select("step", F.col("rgroup").alias("cid"), F.col("score").alias("cos_same"))
    nearb = b.select("step", F.col("rgroup").alias("near_cid"), F.col("score").alias("cos_near"))
    j = (st.select("step", "docid", "cid", "near_cid", dot("qvec", "pvec").alias("cos_qp"))
           .join(same, ["step", "cid"], "left").join(nearb, ["step", "near_cid"], "left"))
    cs = F.coalesce(F.col("cos_same"), F.col("cos_qp"))
    cn = F.when(F.col("near_cid") == F.col("cid"), F.greatest("cos_near", "cos_qp")).otherwise(F.coalesce(F.col("cos_near"), F.col("cos_qp")))
    return j.select("step", "docid", "cos_qp", cs.alias("cos_same"), cn.alias("cos_near"),
                    (F.col("cos_qp") * (1.0 - cs) * (1.0 - cn)).alias("r2"))


def answer_reward(steps: DataFrame, corpus: DataFrame, answers: DataFrame, k_target: float = fixed.K_TARGET) -> DataFrame:
    """r3 = cos(q, A) cos(p, A) (1 - |cos(q, p) - k_target|) with A the answer-snippet embedding.
    ``answers``: (docid, avec) unit vectors."""
    j = (steps.join(corpus.select("docid", F.col("vec").alias("pvec")), "docid").join(answers, "docid"))
    qp = dot("qvec", "pvec")
    return j.select("step", "docid", (dot("qvec", "avec") * dot("pvec", "avec") * (1.0 - F.abs(qp - k_target))).alias("r3"))


def coverage_reward(steps: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """W9 + M11 + U3-U5 over the whole ordered step table at once.

    Neighbours of step t: documents with cos(q_t, d) > threshold.  ``covered`` gains only chosen
    documents (first chosen step per document); a cluster's uncovered set loses the chosen document
    and its same-cluster neighbours (first removal step per document).  For step t:
    global_new = |({d_t} ∪ N_t) − covered_<t|, global_left = N − |covered_<t|,
    add_c = |uncovered_c,<t ∩ ({d_t} ∪ N_t)|, c_left = max(1, |uncovered_c,<t|),
    r4 = w_c · add_c / c_left + (1 − w_c) · global_new / max(1, global_left), w_c = |c| / N.
    """
    n = corpus.count()
    sizes = corpus.groupBy("cid").agg(F.count(F.lit(1)).alias("csize"))
    st = steps.withColumn("sid", F.col("step").cast("string"))
    edges = sim.threshold_edges(st, corpus, threshold, left_id="sid", left_vec="qvec", right_vec="vec")
    touched = (edges.select(F.col("lid").cast("bigint").alias("step"), F.col("rid").alias("doc"))
                    .unionByName(steps.select("step", F.col("docid").alias("doc"))).distinct())
    dcid = corpus.select(F.col("docid").alias("doc"), F.col("cid").alias("dcid"))
    scid = steps.select("step", F.col("cid").alias("scid"), F.col("docid").alias("sdoc"))
    t = touched.join(dcid, "doc").join(scid, "step")
    first_chosen = steps.groupBy(F.col("docid").alias("doc")).agg(F.min("step").alias("chosen_at"))
    removed_at = (t.where((F.col("doc") == F.col("sdoc")) | (F.col("dcid") == F.col("scid")))
                   .groupBy("doc").agg(F.min("step").alias("removed_at")))
    tt = t.join(first_chosen, "doc", "left").join(removed_at, "doc", "left")
    per_step = tt.groupBy("step").agg(
        F.sum(F.when(F.col("chosen_at").isNull() | (F.col("chosen_at") >= F.col("step")), 1).otherwise(0)).alias("global_new"),
        F.sum(F.when((F.col("dcid") == F.col("scid")) & (F.col("removed_at").isNull() | (F.col("removed_at") >= F.col("step"))), 1)
              .otherwise(0)).alias("add_c"))
    # |covered_<t| and |removed from c before t| as running sums over event tables keyed by step
    # (question-sized: one row per step plus one per first choice / removal), strict "< t" frames.
    before = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    ev_c = (first_chosen.select(F.col("chosen_at").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("step"))
            .unionByName(steps.select(F.col("step").alias("at"), F.lit(0).alias("n"), "step")))
    covered_before = (ev_c.withColumn("n_covered", F.coalesce(F.sum("n").over(before), F.lit(0)))
                          .where(F.col("step").isNotNull()).select("step", "n_covered"))
    before_c = Window.partitionBy("ecid").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    ev_r = (removed_at.join(dcid, "doc").select(F.col("dcid").alias("ecid"), F.col("removed_at").alias("at"),
                                               F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("step"))
            .unionByName(steps.select(F.col("cid").alias("ecid"), F.col("step").alias("at"), F.lit(0).alias("n"), "step")))
    removed_before = (ev_r.withColumn("n_removed", F.coalesce(F.sum("n").over(before_c), F.lit(0)))
                          .where(F.col("step").isNotNull()).select("step", "n_removed"))
    r = (steps.select("step", "docid", "cid").join(per_step, "step", "left").join(covered_before, "step")
              .join(removed_before, "step").join(sizes, "cid"))
    wc = F.col("csize") / F.lit(float(n))
    c_left = F.greatest(F.col("csize") - F.col("n_removed"), F.lit(1))
    g_left = F.greatest(F.lit(n) - F.col("n_covered"), F.lit(1))
    r4 = wc * F.coalesce(F.col("add_c"), F.lit(0)) / c_left + (1.0 - wc) * F.coalesce(F.col("global_new"), F.lit(0)) / g_left
    return r.select("step", "docid", F.coalesce("global_new", F.lit(0)).cast("bigint").alias("global_new"),
                    F.coalesce("add_c", F.lit(0)).cast("bigint").alias("add_c"), r4.alias("r4"))


def bank_max_similarity(cands: DataFrame) -> DataFrame:
    """Max cosine of each candidate against every question accepted at an earlier step.
    ``cands``: (cid_key, step, qvec, accepted) — the bank is the accepted rows."""
    bank = cands.where(F.col("accepted")).select(F.col("cid_key").alias("bid"), "step", "qvec")
    m = sim.masked_max(cands, bank, left_id="cid_key", right_id="bid", left_vec="qvec", right_vec="qvec",
                       left_cols={"lorder": "step"}, right_cols={"rorder": "step"})
    return m.select(F.col("lid").alias("cid_key"), F.col("score").alias("bank_max"))


class RunningQuantile:
    """The q-quantile (linear interpolation) of the values so far: a heap of those up to its place, a heap of the rest."""

    def __init__(self, q: float):
        self.q, self.low, self.high = q, [], []

    def __len__(self) -> int:
        return len(self.low) + len(self.high)

    def add(self, value: float) -> None:
        if self.low and value > -self.low[0]:
            heapq.heappush(self.high, value)
        else:
            heapq.heappush(self.low, -value)
        size = math.floor(self.q * (len(self) - 1)) + 1
        while len(self.low) > size:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while len(self.low) < size:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float:
        place = self.q * (len(self) - 1)
        beyond = place - math.floor(place)
        return -self.low[0] if beyond == 0 else (1.0 - beyond) * -self.low[0] + beyond * self.high[0]


def dynamic_threshold(history: DataFrame, base: float = fixed.DEDUP_THRESHOLD, q: float = fixed.DEDUP_QUANTILE,
                      lo: float = fixed.DEDUP_CLIP[0], hi: float = fixed.DEDUP_CLIP[1], min_hist: int = 5) -> DataFrame:
    """Per decision (ordered by ``seq``) the threshold is ``base`` until more than 4 earlier
    values exist, then the q-quantile (linear interpolation) of all earlier values clipped to
    [lo, hi]; the current value joins the history after its threshold is fixed; null values don't join.

    Each threshold depends on all decisions before it, so the question-sized log is read once in its order, with two
    heaps as the state: n log n for n decisions.
    """
    place = history.columns.index("value")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = RunningQuantile(q)
        for b in batches:
            out = []
            for v in b.column(place).to_pylist():
                out.append(min(max(seen.value(), lo), hi) if len(seen) >= min_hist else base)
                if v is not None:
                    seen.add(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "threshold"])

    schema = StructType([*history.schema.fields, StructField("threshold", DoubleType())])
    ordered = history.repartition(1).sortWithinPartitions("seq")
    return ordered.mapInArrow(scan, schema).withColumn("is_dup", F.col("value") >= F.col("threshold"))


def semantic_dedup(cands: DataFrame, tau: float, key: str = "cid_key", order: str = "seq", vec: str = "qvec") -> DataFrame:
    """M13 over a whole table: a question is a duplicate when an *accepted* earlier question has
    cosine >= tau (greedy, first wins, in ``order``).

    Edges (later -> earlier, cosine >= tau) come from the blocked kernel (output-sensitive); ``greedy_first_wins``
    resolves them.  Returns (key, accepted).
    """
    from irforge.session import materialize
    edges = materialize(sim.block_join(cands, cands, "edges_ge", threshold=tau, left_id=key, right_id=key,
                                       left_vec=vec, right_vec=vec, left_cols={"lorder": order},
                                       right_cols={"rorder": order})
                        .select(F.col("lid").alias("node"), F.col("rid").alias("prev")))
    out, _ = greedy_first_wins(cands.select(F.col(key).cast("string").alias("node")), edges)
    return out.select(F.col("node").alias(key), "accepted")


def greedy_first_wins(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, accepted) and the number of rounds: a node of ``nodes`` (node) is accepted when no accepted node is
    among its earlier neighbours, edges(node, prev) without cycles.

    A round rejects the nodes with an accepted earlier neighbour and accepts those whose earlier neighbours are all
    rejected.  A node with one undecided earlier neighbour left is that neighbour's opposite, now and later: it points
    there with a parity, and pointers of pointers are doubled each round, so a chain of n nodes takes about log2 n
    rounds.  The earliest undecided node is decided in every round, so the loop ends and decides all.
    Each round is two joins on written tables; edges of decided nodes are left out.
    """
    from irforge.session import materialize
    first = edges.select("node").distinct().withColumn("later", F.lit(True))
    state = materialize(nodes.join(first, "node", "left").select(
        "node", F.when(F.col("later").isNull(), F.lit(True)).alias("accepted"),
        F.lit(None).cast("string").alias("target"), F.lit(False).alias("flip")))
    rounds = 0
    while state.where("accepted IS NULL").limit(1).count():
        rounds += 1
        undecided = state.where("accepted IS NULL").select("node")
        prev = state.select(F.col("node").alias("prev"), F.col("accepted").alias("prev_accepted"))
        is_open = F.col("prev_accepted").isNull()
        seen = edges.join(undecided, "node", "left_semi").join(prev, "prev").groupBy("node").agg(
            F.max(F.coalesce("prev_accepted", F.lit(False))).alias("any_accepted"),
            F.min(F.when(is_open, F.col("prev"))).alias("open1"), F.max(F.when(is_open, F.col("prev"))).alias("open2"))
        ahead = state.select(F.col("node").alias("target"), F.col("accepted").alias("ahead"), F.col("target").alias("next"), F.col("flip").alias("next_flip"))
        both = state.join(seen, "node", "left").join(ahead, "target", "left")
        accepted = (F.when(F.col("accepted").isNotNull(), F.col("accepted"))
                    .when(F.col("any_accepted"), F.lit(False))
                    .when(F.col("open1").isNull(), F.lit(True))
                    .when(F.col("ahead").isNotNull(), F.col("ahead") != F.col("flip")))
        single = F.when(F.col("open1") == F.col("open2"), F.col("open1"))
        target = F.when(F.col("target").isNull(), single).otherwise(F.coalesce("next", "target"))
        flip = (F.when(F.col("target").isNull(), single.isNotNull())
                .when(F.col("next").isNotNull(), F.col("flip") != F.col("next_flip")).otherwise(F.col("flip")))
        state = materialize(both.select("node", accepted.alias("accepted"), target.alias("target"), flip.alias("flip")))
    return state.select("node", "accepted"), rounds
