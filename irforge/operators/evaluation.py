"""Run evaluation and run/test-set statistics: W3, A9-A13, A16.

Conventions of the standard TREC evaluation tool: a run is re-ranked by score descending with ties
broken by docid descending; gains are the qrels labels; a document is relevant when rel > 0; the
averages run over queries that have at least one relevant document, a query absent from the run
scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_run(run: DataFrame, score_col: str = "score", id_col: str = "docid", start: int = 1) -> DataFrame:
    """Replace the rank by the position under (score desc, docid asc), counting from ``start``."""
    w = Window.partitionBy("qid").orderBy(F.desc(score_col), F.asc(id_col))
    return run.withColumn("rank", (F.row_number().over(w) + (start - 1)).cast("bigint"))


def _eval_rank(run: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(id_col))
    return run.select("qid", id_col, "score").withColumn("erank", F.row_number().over(w))


def per_query_metrics(run: DataFrame, qrels: DataFrame, id_col: str = "docid",
                      ndcg_k: int = 10, recall_k: int = 100, map_k: int = 100, mrr_k: int = 10) -> DataFrame:
    """A9-A11 per query: ndcg@10, recall@100, ap@100 (MAP when averaged), rr@10 (MRR when averaged)."""
    depth = max(ndcg_k, recall_k, map_k, mrr_k)
    rel = qrels.where(F.col("rel") > 0).select("qid", id_col, F.col("rel").cast("double").alias("rel"))
    judged = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    wi = Window.partitionBy("qid").orderBy(F.desc("rel"), F.asc(id_col))
    ideal = (rel.withColumn("ir", F.row_number().over(wi)).where(F.col("ir") <= ndcg_k)
                .groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("ir") + 1.0)).alias("idcg")))
    ranked = _eval_rank(run, id_col).where(F.col("erank") <= depth).join(rel, ["qid", id_col], "left")
    ranked = ranked.withColumn("hit", F.when(F.col("rel") > 0, 1).otherwise(0))
    wc = Window.partitionBy("qid").orderBy("erank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("hits_so_far", F.sum("hit").over(wc))
    agg = ranked.groupBy("qid").agg(
        F.sum(F.when(F.col("erank") <= ndcg_k, F.coalesce(F.col("rel"), F.lit(0.0)) / F.log2(F.col("erank") + 1.0))
              .otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("erank") <= recall_k, F.col("hit")).otherwise(0)).alias("hits_r"),
        F.sum(F.when((F.col("erank") <= map_k) & (F.col("hit") == 1), F.col("hits_so_far") / F.col("erank"))
              .otherwise(0.0)).alias("ap_sum"),
        F.min(F.when((F.col("erank") <= mrr_k) & (F.col("hit") == 1), F.col("erank"))).alias("first_hit"),
    )
    out = judged.join(ideal, "qid").join(agg, "qid", "left")
    return out.select(
        "qid",
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg_10"),
        F.coalesce(F.col("hits_r") / F.col("n_rel"), F.lit(0.0)).alias("recall_100"),
        F.coalesce(F.col("ap_sum") / F.col("n_rel"), F.lit(0.0)).alias("ap_100"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr_10"),
    )


def metrics_summary(per_query: DataFrame) -> DataFrame:
    """A9-A11 aggregated: nDCG@10, R@100, MAP@100, MRR@10 and the number of judged queries."""
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("ndcg_10").alias("ndcg_10"), F.avg("recall_100").alias("recall_100"),
        F.avg("ap_100").alias("map_100"), F.avg("rr_10").alias("mrr_10"))


def depth_report(run: DataFrame, depth: int = 100, id_col: str = "docid") -> DataFrame:
    """Queries with >= depth results, with fewer, and min/max results per query.

    The reference prints the first count under a label saying the opposite; both are reported here
    under their real meaning.
    """
    per_q = run.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return per_q.agg(
        F.sum(F.when(F.col("n") >= depth, 1).otherwise(0)).cast("bigint").alias("n_full_depth"),
        F.sum(F.when(F.col("n") < depth, 1).otherwise(0)).cast("bigint").alias("n_short"),
        F.min("n").alias("min_results"), F.max("n").alias("max_results"))


def pooled_docs(run: DataFrame, k: int = 100, id_col: str = "docid") -> DataFrame:
    """Distinct documents in the top-k over all queries, and total occurrences."""
    top = run.where(F.col("rank") <= k)
    return top.agg(F.countDistinct(id_col).alias("n_distinct_docs"), F.count(F.lit(1)).alias("n_occurrences"))


def predictions_map(run: DataFrame, id_col: str = "docid") -> DataFrame:
    """Per query a map docid -> score (one row per query)."""
    return run.groupBy("qid").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(id_col, "score")))).alias("scores"))
