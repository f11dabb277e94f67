"""Second-stage scoring of a run (X3 with bundled scorers, F7) and the nested test set."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irforge.operators import evaluation as ev
from irforge.operators.common import bounded_broadcast
from irforge.operators.lexical import with_term_frequencies


def two_logit_log_softmax(a: Column, b: Column) -> Column:
    """log P(first) from two logits, computed stably."""
    m = F.greatest(a, b)
    return a - (m + F.log(F.exp(a - m) + F.exp(b - m)))


def tf_cosine_scores(pairs: DataFrame, id_col: str = "docid") -> DataFrame:
    """Bundled lexical scorer: cosine of term-count vectors of query and passage text.

    ``pairs``: (qid, query, docid, text).  Every distinct passage and query is tokenised once; term
    counts come back to the pairs by id, and the dot product is taken inside the row over the query's
    terms, so no terms are exploded or shuffled.
    """
    def counted(df: DataFrame, key: str, text: str, tfs: str, norm: str) -> DataFrame:
        t = with_term_frequencies(df.select(key, text).dropDuplicates([key]), text, out_col=tfs).drop(text)
        return t.withColumn(norm, F.sqrt(F.aggregate(tfs, F.lit(0.0), lambda acc, x: acc + x["tf"] * x["tf"])))

    p = counted(pairs, id_col, "text", "tfs", "dn").withColumn("counts", F.map_from_entries("tfs")).drop("tfs")
    q = counted(pairs, "qid", "query", "qtfs", "qn")
    s = pairs.select("qid", id_col).join(q, "qid").join(p, id_col)
    dot = F.aggregate("qtfs", F.lit(0.0), lambda acc, x: acc + x["tf"] * F.coalesce(F.try_element_at("counts", x["term"]), F.lit(0)))
    return s.select("qid", id_col, F.coalesce(F.try_divide(dot, F.col("dn") * F.col("qn")), F.lit(0.0)).alias("cos"))


def rerank(pairs: DataFrame, scorer: str | Callable = "tf_cosine", id_col: str = "docid") -> DataFrame:
    """Score every (query, passage) pair and re-rank: (qid, docid, score, rank).

    ``scorer`` is ``"tf_cosine"`` (bundled, two logits (10 cos, -10 cos) turned into log P(true)
    by F7) or a user function ``list[str], list[str] -> list[float]`` applied in Arrow batches.
    """
    if scorer == "tf_cosine":
        c = tf_cosine_scores(pairs, id_col)
        scored = c.select("qid", id_col, two_logit_log_softmax(10.0 * F.col("cos"), -10.0 * F.col("cos")).alias("score"))
    else:
        fn = scorer

        @F.pandas_udf("double")
        def _score(q: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(fn(q.tolist(), d.tolist()), dtype="float64")

        scored = pairs.select("qid", id_col, _score(F.col("query"), F.col("text")).alias("score"))
    return ev.rank_run(scored, "score", id_col, start=0)  # ranks from 0, as the reference's toolkit


def nested_testset(run: DataFrame, topics: DataFrame, texts: DataFrame, k: int = 100, id_col: str = "docid") -> DataFrame:
    """(qid, qtext struct<title>, passages array<struct<docid, text>>) in score order.

    Top-k by score per query, text looked up once per pooled document (distinct docids, J4 / A13),
    passages without text skipped; a query with no text keeps an empty list.  The per-query
    collect is bounded by k.
    """
    top = run.where(F.col("rank") <= k)
    pool = top.select(id_col).distinct()
    looked = texts.join(bounded_broadcast(pool), id_col).where(F.col("text").isNotNull() & (F.col("text") != ""))
    j = top.join(looked, id_col, "left")
    passages = (j.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(),
                                           F.struct(F.col("rank").alias("r"), F.col(id_col).alias("docid"), "text")))).alias("p"))
        .select("qid", F.transform("p", lambda s: F.struct(s["docid"].alias("docid"), s["text"].alias("text"))).alias("passages")))
    return (passages.join(topics, "qid")
            .select("qid", F.struct(F.col("query").alias("title")).alias("qtext"), "passages"))


def explode_testdata(nested: DataFrame) -> DataFrame:
    """Nested test set -> (qid, query, docno, text, pos)."""
    e = nested.select("qid", F.col("qtext.title").alias("query"), F.posexplode("passages").alias("pos", "p"))
    return e.select("qid", "query", F.col("p.docid").alias("docno"), F.col("p.text").alias("text"), (F.col("pos") + 1).alias("pos"))
