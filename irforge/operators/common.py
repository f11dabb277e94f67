"""Physical helpers shared by the operators: size-checked broadcast and skew-safe top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Broadcast a side only when it has at most this many rows (checked with a count, not assumed).
BROADCAST_MAX_ROWS = 2_000_000
# Number of buckets used to split one hot group of a top-k before the final merge.
TOPK_SPLIT_BUCKETS = 16


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` if a count proves ``df`` small, else ``df`` for a shuffle join.

    The count is one cheap action on a side that is small by construction (queries, centroids,
    items); when it is not, the join falls back to sort-merge and AQE's skew-join split.
    """
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def topk_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                   rank_col: str = "rank", split_col: str | None = None,
                   buckets: int = TOPK_SPLIT_BUCKETS) -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order``, with a ``rank`` column (1-based).

    Two phases so that one hot group (say a query matching a third of the corpus) is not sorted in
    a single task: first top-k within (group, hash bucket of ``split_col``), then top-k over at most
    ``buckets * k`` survivors per group.
    """
    if split_col is not None and buckets > 1:
        bucket = F.pmod(F.xxhash64(F.col(split_col)), F.lit(buckets))
        w1 = Window.partitionBy(*group_cols, "__bucket").orderBy(*order)
        df = (df.withColumn("__bucket", bucket)
                .withColumn("__r1", F.row_number().over(w1))
                .where(F.col("__r1") <= k)
                .drop("__bucket", "__r1"))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= k)


def with_position(df: DataFrame, *order: str, out: str = "seq") -> DataFrame:
    """``df`` plus its 0-based position (long) in ascending ``order``, nulls first; rows that tie get distinct
    positions in an order of their own.

    Two passes: the rows are sorted by ranges and written with their place in their partition, then every partition's
    offset (one row for each partition) is added.  No task sees more than its range.
    """
    from irforge.session import materialize
    sorted_rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted_rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .select(*df.columns, (F.col("_offset") + place).alias(out)))
