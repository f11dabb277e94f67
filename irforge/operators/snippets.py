"""Answerable snippet per document — the 70-token window (stride 35) containing the most of
the document's heaviest TF-IDF terms as substrings of the lower-cased window; the first best window
wins; documents of at most 70 tokens are their own snippet.  All per-row array work in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.functions.text import py_split


def answer_snippets(docs: DataFrame, top_terms: DataFrame, win: int = fixed.SNIPPET_WINDOW,
                    n_keys: int = fixed.SNIPPET_TERMS, id_col: str = "docid", text_col: str = "doctext") -> DataFrame:
    """(docid, start, snippet); start = -1 for documents that are not windowed."""
    stride = max(10, win // 2)
    keys = (top_terms.where(F.col("term_rank") <= n_keys).groupBy(id_col)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("term_rank", "term"))), lambda s: s["term"]).alias("keys")))
    d = (docs.select(id_col, text_col).join(keys, id_col, "left")
             .withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
             .withColumn("toks", py_split(F.col(text_col))))
    n = F.size("toks")
    starts = F.when(n > win, F.sequence(F.lit(0), n - win, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("starts", starts)
    d = d.withColumn("segs", F.transform("starts", lambda s: F.lower(F.array_join(F.slice(F.col("toks"), s + 1, win), " "))))
    d = d.withColumn("scored", F.transform("segs", lambda seg, i: F.struct(
        F.size(F.filter(F.col("keys"), lambda k: F.instr(seg, k) > 0)).alias("score"), (-i).alias("neg_i"))))
    best = F.array_max("scored")
    start = F.when(n > win, F.element_at(F.col("starts"), -best["neg_i"] + 1)).otherwise(F.lit(-1))
    d = d.withColumn("start", start)
    snippet = F.when(n > win, F.array_join(F.slice(F.col("toks"), F.col("start") + 1, win), " ")).otherwise(F.col(text_col))
    return d.select(id_col, F.col("start").cast("bigint").alias("start"), snippet.alias("snippet"))
