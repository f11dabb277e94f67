"""Writers for the record formats the jobs produce.

Distributed writes (one file per partition); text formats are written with ``concat_ws`` so that no
row passes through the driver.  Ordered outputs are sorted by Spark before writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irforge.operators.mining import tsv_safe


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1/K3/K5: JSON lines, non-ASCII kept as is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """K2: embedding store as Parquet (docid, vec)."""
    df.write.mode("overwrite").parquet(path)


def append_step_log(df: DataFrame, path: str) -> None:
    """Append rows of a log (one write per round) so a partial run survives."""
    df.write.mode("append").json(path)


def write_sorted_ids(df: DataFrame, path: str, id_col: str = "docid", order_col: str | None = None) -> None:
    """K6: one id per line, sorted."""
    df.select(id_col, *( [order_col] if order_col else [])).orderBy(order_col or id_col) \
      .select(F.col(id_col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_exemplars(df: DataFrame, path: str) -> None:
    """K7: 'Example i:\\nPassage: p\\nQuery: q' blocks separated by blank lines, i = row position."""
    blocks = df.select(F.format_string("Example %d:\nPassage: %s\nQuery: %s\n", F.col("i"), F.col("passage"), F.col("query"))
                       .alias("value"), "i").orderBy("i").select("value")
    blocks.coalesce(1).write.mode("overwrite").text(path)


def write_topics_tsv(df: DataFrame, path: str) -> None:
    """K8: 'qid \\t text' rows."""
    _write_tsv(df.select(F.col("qid").cast("string"), tsv_safe(F.col("query"))), path)


def write_trec_run(run: DataFrame, path: str, tag: str = "irforge") -> None:
    """K9: 'qid Q0 docid rank score tag'."""
    run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "docid", F.col("rank").cast("string"),
                           F.col("score").cast("string"), F.lit(tag)).alias("value")).write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    """K10: 'qid 0 docid label'."""
    qrels.select(F.concat_ws(" ", "qid", F.lit("0"), "docid", F.col("rel").cast("string")).alias("value")) \
         .write.mode("overwrite").text(path)


def write_nested_testset(nested: DataFrame, path: str) -> None:
    """One JSON line per query: {qid, qtext: {title}, passages: [[docid, text], ...]}."""
    nested.select("qid", "qtext", F.transform("passages", lambda p: F.array(p["docid"], p["text"])).alias("passages")) \
          .write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_rerank_train(rows: DataFrame, path: str) -> None:
    """JSON lines [query, doc, label] with a numeric label, the positive first then its negatives.

    Both texts go through ``to_json`` for escaping; the label is written as a bare number, since the
    consumer compares it with 1.0.
    """
    texts = F.to_json(F.array(F.coalesce("query", F.lit("")), F.coalesce("doc", F.lit(""))))
    label = F.format_string("%.1f", F.col("label").cast("double"))
    rows.orderBy("qid", "neg_no").select(F.concat(texts.substr(F.lit(1), F.length(texts) - 1), F.lit(","), label, F.lit("]")).alias("value")) \
        .write.mode("overwrite").text(path)


def write_triples(tr: DataFrame, path: str) -> None:
    """K13: 'query \\t positive \\t negative' with tabs/newlines inside fields replaced."""
    tr.select(F.concat_ws("\t", tsv_safe(F.col("query")), tsv_safe(F.col("positive")), tsv_safe(F.col("negative"))).alias("value")) \
      .write.mode("overwrite").text(path)


def write_predictions(pred: DataFrame, path: str) -> None:
    """One JSON object per query {qid, scores: {docid: score}}."""
    pred.write.mode("overwrite").json(path)


def write_metrics_csv(per_dataset: DataFrame, path: str) -> None:
    """Dataset,ndcg@10,map@100,recall@100,mrr@10 (long (dataset, metric, value) -> wide)."""
    wide = per_dataset.groupBy("dataset").pivot("metric", ["ndcg@10", "map@100", "recall@100", "mrr@10"]).agg(F.first("value"))
    wide.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_collection_tsv(df: DataFrame, path: str, id_col: str = "docid", text_col: str = "doctext") -> None:
    """K17: 'id \\t text' collection or query file for a late-interaction index."""
    _write_tsv(df.select(F.col(id_col).cast("string"), tsv_safe(F.col(text_col))), path)


def _write_tsv(df: DataFrame, path: str) -> None:
    """Raw tab-separated lines: the consumers split on tabs and know no quoting; null is an empty field."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)
