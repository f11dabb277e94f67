"""Collection status plans (A14, A15, J17), positional alignment (J2) and the K grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.operators import clusters as C
from irforge.operators.common import with_position
from irforge.sources import tables as T

COMPLETE_MIN_DOCS = 100  # fixed value: a dataset counts as complete above this many documents


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, questions and judged queries per dataset."""
    d = T.documents_with_dataset(spark, sf_dir).select("docid", "dataset")
    q = T.generated_questions(spark, sf_dir).select("docid").join(d, "docid")
    judged = T.containment_qrels(spark, sf_dir).join(d, "docid").select("dataset", "qid").distinct()
    nd = d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_docs"))
    nq = q.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_questions"))
    nj = judged.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_judged_queries"))
    return (nd.join(nq, "dataset", "left").join(nj, "dataset", "left")
              .select("dataset", "n_docs", F.coalesce("n_questions", F.lit(0)).alias("n_questions"),
                      F.coalesce("n_judged_queries", F.lit(0)).alias("n_judged_queries")))


def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset is complete when it has more than 100 documents."""
    d = T.documents_with_dataset(spark, sf_dir)
    return d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("complete", F.col("n_docs") > COMPLETE_MIN_DOCS)


def artifact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset x artifact status (documents present, embeddings present) by a left join from
    the dataset list."""
    d = T.documents_with_dataset(spark, sf_dir).select("docid", "dataset")
    e = T.embeddings(spark, sf_dir).select("docid")
    datasets = d.select("dataset").distinct()
    nd = d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_docs"))
    ne = d.join(e, "docid").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_embedded"))
    j = datasets.join(nd, "dataset", "left").join(ne, "dataset", "left")
    return j.select("dataset", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_embedded", F.lit(0)).alias("n_embedded"),
                    (F.coalesce("n_docs", F.lit(0)) > 0).alias("has_documents"),
                    (F.coalesce("n_embedded", F.lit(0)) > 0).alias("has_embeddings"))


def zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach the i-th vector to the i-th document (documents that have embeddings, in id order);
    the row counts must match."""
    d = T.documents(spark, sf_dir).join(T.embeddings(spark, sf_dir).select("docid"), "docid", "left_semi") \
         .select("docid", F.col("docid").cast("bigint").alias("ord"))
    e = T.table(spark, sf_dir, "embeddings").select("vec_id")
    nd, ne = d.count(), e.count()
    if nd != ne:
        raise ValueError(f"Embeddings count mismatch: {ne} vectors for {nd} documents")
    dp = with_position(d, "ord").select("seq", "docid")
    ep = with_position(e, "vec_id").select("seq", "vec_id")
    return dp.join(ep, "seq").select(F.col("seq").cast("bigint").alias("seq"), "docid", "vec_id")


def candidate_k_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the K grid for the corpus size N of the embeddings table."""
    n = T.table(spark, sf_dir, "embeddings").count()
    return spark.createDataFrame([(k,) for k in C.candidate_k_grid(n)], "k int")
