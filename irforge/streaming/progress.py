"""ST1: running progress of a question-selection run from arriving step-log files.

The selection loop appends one JSON line per step (K4).  A Structured Streaming query tails the
folder and keeps per-cluster running aggregates in its state store; ``availableNow`` processes
everything present and stops, so a batch check can compare it with the batch aggregate (A19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_LOG_SCHEMA = ("step long, weights array<double>, reward array<double>, cid int, doc_idx string, "
                   "best_score double, advantage double, baseline double")


def progress_aggregate(log: DataFrame) -> DataFrame:
    """Per cluster: accepted steps, mean score, mean advantage, last step seen (same for batch and stream)."""
    return log.groupBy("cid").agg(F.count(F.lit(1)).alias("n_steps"), F.avg("best_score").alias("mean_score"),
                                  F.avg("advantage").alias("mean_advantage"), F.max("step").alias("last_step"))


def start_progress_stream(spark: SparkSession, log_dir: str, checkpoint_dir: str, query_name: str,
                          available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the streaming aggregate into an in-memory table named ``query_name`` (complete mode)."""
    reader = spark.readStream.schema(STEP_LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(log_dir)
    w = (progress_aggregate(stream).writeStream.outputMode("complete").format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
