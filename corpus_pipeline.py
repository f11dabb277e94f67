"""A corpus-cleaning pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written
as Parquet in the shared checkpoint folder and read again.  All stages but the last return the columns
of documents:

1. toxicity        documents predicted toxic go (labels of the training share only)
2. line_dedup      lines found in at least ten of the remaining documents go from all texts
3. jaccard_join    one document of each component of similar documents stays
4. decontamination documents that leak a benchmark item go
5. packing         the rest is tokenized and cut into power-of-two sequences

Stages 2 to 5 work on all that the stage before kept, and corpus statistics are taken from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from irforge.llm.base import crc_mod, documents
from irforge.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    score = toxicity.scorer(docs, model)
    return docs.where(toxicity.predicted(score(F.col("text"))) == 0)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_frequent_lines(docs).drop("n_lines", "n_dropped")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The decoder, the regression and the LSH of the stages are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = materialize(out)
    return out
