"""Choice of a step's question among its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_candidate(cands: DataFrame, rewards: str = "r") -> DataFrame:
    """One row per step: its candidate with the highest mean reward that is no duplicate, the first of
    equals; the reserve if all others are duplicates.

    ``cands``: step, cand, reserve (boolean), is_dup (boolean, null: not compared), an array of rewards
    and any further columns.  Adds ``score``, the mean reward.
    """
    mean = F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x) / F.size(rewards)
    turn = F.when(F.col("reserve"), 1).when(F.coalesce("is_dup", F.lit(False)), 0).otherwise(2)
    rows = cands.withColumn("score", mean)
    whole = F.struct(*[F.col(c) for c in rows.columns if c != "step"])
    return rows.groupBy("step").agg(F.max_by(whole, F.struct(turn, F.col("score"), -F.col("cand"))).alias("b")).select("step", "b.*")
