"""Two-pass external shuffle into shards.

Pass 1 scatters whole records into memory-sized buckets by seeded hashes: rendezvous hashing of the
document id picks the shard (the highest of one hash per shard wins, so one more shard only takes
rows into itself), and a second hash of the id and the text spreads a shard over as many buckets as
its bytes need.  Pass 2 loads one bucket at a time, puts its rows into a fixed order and
Fisher-Yates-shuffles them with a generator seeded by the bucket; a bucket's place in its shard is
the number of rows in the shard's earlier buckets, so slots have no gaps.

Every choice is a function of the row and the seed: a lost executor's buckets are recomputed to the
same rows in the same order.

Defined cases: null text has no bytes (size 8) and null crc; a null id hashes like any key; repeated
rows each get their own slot; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irforge.llm.base import documents

SHARDS = 24
BUCKET_BYTES = 16 << 20
SEED = 20240229


def shard_of(key: Column, n: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is largest."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                   lambda s: F.struct(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00")), s, F.lit(seed)).alias("h"), s.alias("s"))))["s"]


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffle_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (its columns, at least doc_id and text) plus shard int, bucket int and slot long.

    Input columns called shard, bucket, start or slot give way to the new ones.
    """
    docs = docs.drop("shard", "bucket", "start", "slot")
    total = docs.agg(F.sum(record_bytes(F.col("text")))).first()[0] or 0
    per_shard = max(1, -(-total // (n_shards * bucket_bytes)))
    key = docs.withColumn("shard", shard_of(F.col("doc_id"), n_shards, seed)) \
              .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(per_shard)).cast("int"))
    # one row per bucket, from the id and text hashes alone
    sizes = key.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    schema = T.StructType([*key.schema.fields, T.StructField("slot", T.LongType())])

    def fisher_yates(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]).to_numpy().copy()
        rng = np.random.Generator(np.random.PCG64([seed, rows["shard"][0].as_py(), rows["bucket"][0].as_py()]))
        rng.shuffle(order)  # Fisher-Yates
        out = rows.take(pa.array(order))
        slot = pc.add(out["start"], pa.array(np.arange(len(order)), pa.int64()))
        return out.drop_columns(["start"]).append_column("slot", slot)

    return key.join(starts, ["shard", "bucket"]).select(*key.columns, "start").groupBy("shard", "bucket").applyInArrow(fisher_yates, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard and bucket, its rows in slot order."""
    shuffled.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "slot") \
        .write.partitionBy("shard", "bucket").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = shuffle_shards(docs)
    return out.select(
        "doc_id", record_bytes(F.col("text")).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))
