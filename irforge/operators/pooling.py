"""Masked mean pooling of token embeddings (docid, pos, mask, tvec) -> (docid, pooled)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked_mean(tokens: DataFrame, id_col: str = "docid") -> DataFrame:
    """Mean of the unmasked token vectors per document (vector aggregation in the JVM)."""
    kept = tokens.where(F.col("mask") == 1)
    return (kept.groupBy(id_col).agg(Summarizer.mean(array_to_vector("tvec")).alias("m"),
                                     F.count(F.lit(1)).alias("n_tokens"))
                .select(id_col, vector_to_array("m").alias("pooled"), "n_tokens"))
