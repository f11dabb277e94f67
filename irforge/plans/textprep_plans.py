"""Text-preparation plans over the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.functions import fixed
from irforge.functions.text import ws_token_count
from irforge.operators import textprep as tp
from irforge.sources import tables as T

# A user-supplied prompt template (S11 reads one from a file); fields {document} and {query}.
DEMO_TEMPLATE = "Example 1:\nDocument: {document}\nRelevant Query: {query}\n"


def merge_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.corpus(spark, sf_dir)
    return c.select("docid", tp.merge_title_text(F.col("title"), F.col("text")).alias("doctext"))


def filter_len_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents_with_dataset(spark, sf_dir)
    return tp.filter_len_sampling(d, F.col("dataset")).select("docid", "dataset", F.length("doctext").cast("bigint").alias("n_chars"))


def filter_len_kselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents_with_dataset(spark, sf_dir)
    return tp.filter_len_kselect(d, F.col("dataset")).select("docid", "dataset", F.length("doctext").cast("bigint").alias("n_chars"))


def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents(spark, sf_dir)
    t = d.select("docid", tp.truncate_tokens(F.col("doctext")).alias("doctext"))
    return t.select("docid", "doctext", ws_token_count(F.col("doctext")).cast("bigint").alias("n_tokens"))


def text_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents(spark, sf_dir)
    return d.select("docid", tp.text_prefix(F.col("doctext"), fixed.EXEMPLAR_CHARS).alias("exemplar"),
                    tp.text_prefix(F.col("doctext"), fixed.ANSWER_FALLBACK_CHARS).alias("answer"))


def clean_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.generated_questions(spark, sf_dir)
    return q.select("docid", "seq", tp.clean_question(F.col("question")).alias("question"))


def kept_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tp.cleaned_questions(T.generated_questions(spark, sf_dir))
    return q.select("docid", "seq", "question", F.length("doctext").cast("bigint").alias("doc_chars"))


def clean_llm_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.model_outputs(spark, sf_dir)
    return o.select("docid", "turn", tp.clean_llm_output(F.col("output"), F.col("prompt")).alias("question"))


def extract_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.model_outputs(spark, sf_dir)
    return o.select("docid", "turn", tp.extract_question(F.col("output")).alias("question"))


def render_fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents(spark, sf_dir)
    shots = [fixed.PAD_EXEMPLAR] * 3
    return d.select("docid", tp.render_fewshot_prompt(F.col("doctext"), shots).alias("prompt"))


def render_template_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents(spark, sf_dir)
    return d.select("docid", tp.render_template_prompt(DEMO_TEMPLATE, tp.truncate_tokens(F.col("doctext"))).alias("prompt"))


def doc_text_join_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.corpus(spark, sf_dir)
    return c.select("docid", tp.doc_text_join_fields(F.col("title"), F.col("text"), True).alias("multifield"),
                    tp.doc_text_join_fields(F.col("title"), F.col("text"), True, " ").alias("lookup"))
