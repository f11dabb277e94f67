"""Readers for the record formats the jobs exchange.

All readers take explicit schemas (no inference pass over the data) and return lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_SCHEMA = "docid string, doctext string"
CORPUS_SCHEMA = "_id string, title string, text string"
QUERY_SCHEMA = "_id string, text string"
QUESTION_SCHEMA = "docid string, doctext string, question string"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """JSONL documents -> (docid, doctext); ids are read as strings."""
    return spark.read.schema(DOC_SCHEMA).json(path)


def read_embeddings(spark: SparkSession, path: str, key: str = "docid", vec: str = "embedding") -> DataFrame:
    """Keyed embedding store (Parquet) -> (docid STRING, vec ARRAY<DOUBLE>); keys cast to string."""
    e = spark.read.parquet(path)
    return e.select(F.col(key).cast("string").alias("docid"), F.col(vec).cast("array<double>").alias("vec"))


def read_beir(spark: SparkSession, corpus_path: str, queries_path: str, qrels_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: BEIR-style corpus.jsonl, queries.jsonl and a TSV qrels file with a header row."""
    corpus = spark.read.schema(CORPUS_SCHEMA).json(corpus_path).select(
        F.col("_id").alias("docid"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    queries = spark.read.schema(QUERY_SCHEMA).json(queries_path).select(F.col("_id").alias("qid"), F.col("text").alias("query"))
    qrels = (spark.read.option("sep", "\t").option("header", "true").schema("qid string, docid string, rel int").csv(qrels_path))
    return corpus, queries, qrels


def read_generated_questions(spark: SparkSession, path: str) -> DataFrame:
    """Generated-question JSONL (docid, doctext, question); docid repeats.

    ``seq`` orders rows as (file path, place in the file): splits of a file are read in order within a
    partition, so the row number of the scan orders the rows of one block, the block start the blocks
    of one file, and the path the files.
    """
    raw = spark.read.schema(QUESTION_SCHEMA).json(path)
    return raw.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """S5: 'qid Q0 docid rank score tag' lines -> (qid, docid, rank, score)."""
    p = F.split(F.col("value"), " ")
    return spark.read.text(path).select(p[0].alias("qid"), p[2].alias("docid"), p[3].cast("int").alias("rank"),
                                        p[4].cast("double").alias("score"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """S6: 'qid 0 docid label' lines -> (qid, docid, rel)."""
    p = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).select(p[0].alias("qid"), p[2].alias("docid"), p[3].cast("int").alias("rel"))


def read_nested_testset(spark: SparkSession, path: str) -> DataFrame:
    """S7 input: {qid, qtext: {title}, passages: [[docid, text], ...]}, one object per line in any number
    of files, or one JSON array of such objects per file."""
    schema = "qid string, qtext struct<title:string>, passages array<array<string>>"
    head = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    raw = spark.read.schema(schema).option("multiLine", str(array).lower()).json(path)
    return raw.select("qid", "qtext", F.transform("passages", lambda p: F.struct(p[0].alias("docid"), p[1].alias("text"))).alias("passages"))


def read_rerank_train(spark: SparkSession, path: str) -> DataFrame:
    """JSON-array lines [query, doc, label] -> (query, doc, label)."""
    a = F.from_json(F.col("value"), "array<string>")
    return spark.read.text(path).select(a[0].alias("query"), a[1].alias("doc"), a[2].cast("double").alias("label"))


def topics_join(run: DataFrame, topics: DataFrame) -> DataFrame:
    """Attach topic text by qid; ids compared as strings, and as integers when the string form
    differs (leading zeros), mirroring the string-key-then-integer-key lookup."""
    t = topics.select(F.col("qid").cast("string").alias("tqid"), "query")
    by_str = run.join(t, run["qid"] == t["tqid"], "left").drop("tqid")
    missing = by_str.where(F.col("query").isNull()).drop("query")
    found = by_str.where(F.col("query").isNotNull())
    t_int = t.select(F.expr("try_cast(tqid as bigint)").alias("tq_int"), F.col("query"))
    by_int = (missing.join(t_int, F.expr("try_cast(qid as bigint)") == F.col("tq_int"), "left").drop("tq_int"))
    return found.unionByName(by_int)


def raw_doc_fields(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Title and text of an indexed document's raw JSON (parsed, not split on quotes)."""
    return df.withColumn("title", F.coalesce(F.get_json_object(F.col(raw_col), "$.title"), F.lit(""))) \
             .withColumn("text", F.coalesce(F.get_json_object(F.col(raw_col), "$.text"), F.lit("")))


def read_prompt_template(spark: SparkSession, path: str, key: str = "3-shot") -> str:
    """The template under ``key`` of a small YAML file, either as ``key:`` with a nested
    ``template: |`` block or as ``key: |`` itself.  Read through Spark, so any file system works."""
    lines = spark.read.text(path, wholetext=True).first()["value"].splitlines()
    indent = lambda ln: len(ln) - len(ln.lstrip(" "))
    at = next((i for i, ln in enumerate(lines) if ln.strip().split(":")[0].strip("\"'") == key), None)
    if at is None:
        raise KeyError(f"no template {key!r} in {path}")
    block = []
    for ln in lines[at + 1:]:
        if ln.strip() and indent(ln) <= indent(lines[at]):
            break
        block.append(ln)
    inner = next((i for i, ln in enumerate(block) if ln.strip().startswith("template:")), None)
    if inner is not None:
        deep = indent(block[inner])
        rest = block[inner + 1:]
        block = rest[:next((i for i, ln in enumerate(rest) if ln.strip() and indent(ln) <= deep), len(rest))]
    cut = min((indent(ln) for ln in block if ln.strip()), default=0)
    return "\n".join(ln[cut:] for ln in block).rstrip("\n") + "\n"
