"""Hard-negative mining and training-set assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.operators import textprep as tp


def tail_negatives(run: DataFrame, texts: DataFrame, n: int = fixed.NUM_POS_TO_NEG, compat: bool = True,
                   drop_empty: bool = False, id_col: str = "docid", missing: Observation | None = None) -> DataFrame:
    """Negatives from the tail of each ranking: (qid, docid, neg_no, text).

    compat=True reproduces Python slicing ``docids[len - 2n:]``: for rankings shorter than 2n the
    start index is negative, so with n < len < 2n only the last 2n - len documents survive and with
    len <= n all do.  compat=False takes the last min(2n, len) and never the positive itself.
    Documents without text are skipped (empty text counts as present unless ``drop_empty``), then
    the first n survivors are kept.  Windows are per query (ranking-sized partitions).  An observation
    ``missing`` gets ``n_missing``, the tail rows without text, and ``n_tail`` from the first action, with no second pass.
    """
    w = Window.partitionBy("qid")
    r = run.withColumn("__len", F.count(F.lit(1)).over(w)).withColumn(
        "__pos", F.row_number().over(w.orderBy("rank")) - 1)
    if compat:
        start = F.when(F.col("__len") - 2 * n >= 0, F.col("__len") - 2 * n).otherwise(
            F.greatest(F.lit(0), 2 * F.col("__len") - 2 * n))
    else:
        start = F.greatest(F.lit(0), F.col("__len") - 2 * n)
        r = r.where(F.col(id_col) != F.col("qid"))
    tail = r.where(F.col("__pos") >= start)
    j = tail.join(texts, id_col, "left")
    present = tp.present_text(F.col("text"), allow_empty=not drop_empty)
    if missing is not None:
        j = j.observe(missing, F.count(F.when(present, None).otherwise(F.lit(1))).alias("n_missing"), F.count(F.lit(1)).alias("n_tail"))
    j = j.where(present)
    wn = Window.partitionBy("qid").orderBy("__pos")
    return (j.withColumn("neg_no", F.row_number().over(wn).cast("bigint")).where(F.col("neg_no") <= n)
             .select("qid", id_col, "neg_no", "text"))


def rerank_training_rows(questions: DataFrame, negatives: DataFrame) -> DataFrame:
    """J15 + U6 + K12: per question with at least one negative: the positive (label 1.0, neg_no 0)
    and its negatives (label 0.0); questions with no negative are dropped entirely."""
    has = negatives.select("qid").distinct()
    q = questions.join(has, "qid", "left_semi")
    pos = q.select("qid", F.lit(0).cast("bigint").alias("neg_no"), F.col("qtext").alias("query"),
                   F.col("doctext").alias("doc"), F.lit(1.0).alias("label"))
    neg = (negatives.join(questions.select("qid", "qtext"), "qid")
           .select("qid", "neg_no", F.col("qtext").alias("query"), F.col("text").alias("doc"), F.lit(0.0).alias("label")))
    return pos.unionByName(neg)


def triples(questions: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query, positive, negative) per mined negative."""
    return (negatives.join(questions, "qid")
            .select("qid", "neg_no", F.col("qtext").alias("query"), F.col("doctext").alias("positive"),
                    F.col("text").alias("negative")))


def tsv_safe(c) -> F.Column:
    """Tabs and newlines inside a field would break a TSV row; replace them by spaces."""
    return F.regexp_replace(c, r"[\t\r\n]", " ")


def reranker_inputs(rows: DataFrame) -> DataFrame:
    """P12 + P13: text-to-text training pairs ('Query: q Document: d Relevant:', 'true'|'false')."""
    return rows.select("qid", "neg_no", tp.render_rerank_prompt(F.col("query"), F.col("doc")).alias("input"),
                       tp.label_to_token(F.col("label")).alias("target"))
