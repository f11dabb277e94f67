"""Document fingerprints by Order MinHash, as Spark column expressions only.

A text's k-mers are runs of ``K`` tokens (white-space words, cut after ``TOKEN`` characters).  The n-th
copy of a k-mer is a k-mer of its own (occurrence numbers).  Each of ``SIZE`` hash orders picks the
``TAKEN`` smallest of all numbered k-mers, puts them back into text order and hashes the tuple: two texts
agree at a place only if they share these k-mers in the same order, which follows edit distance and
not just content.  ``SIZE / 2`` hash functions give the orders, each read from both of its ends.  Nothing
is sampled or cut: every numbered k-mer takes part in every order.

Ranks and k-mers are sorted as longs, the place in the low 31 bits and 33 bits of the hash above them.

``with_next`` brings every document's successor in descending id order next to it without a global
sort: ids are cut into buckets at their approximate quantiles, the largest id's row of a bucket is copied
to the end of the bucket before it, and a window looks one row ahead.

Defined cases: null text is empty; a text without tokens has one k-mer, the text itself; rows that
share an id are ordered by text; a row with a null id has no place in the order, its next document
is empty; the only document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irforge.llm.base import documents

K = 2
TOKEN = 16
SIZE = 16
TAKEN = 2
ROWS_PER_BUCKET = 1000
MAX_BUCKETS = 1 << 16
#: Low bits of a sorted long: the place of its k-mer.
PLACE = (1 << 31) - 1


def _sorted(values: str, of) -> Column:
    """The longs ``of(x)`` for the column's elements in ascending order, each with its place in the low bits."""
    return F.sort_array(F.transform(values, lambda x, i: of(x).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE)).cast("int")


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` plus ``out``, array<long> of SIZE tuple hashes (32 bits each) of the column ``text``."""
    keep = [F.col(c) for c in df.columns]
    tokens = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0))
    df = df.select(*keep, F.transform(tokens, lambda t: F.xxhash64(t)).alias("_t"))
    runs = F.expr("slice(_t, 1, size(_t) - 1)")
    runs = F.zip_with(runs, F.expr("slice(_t, 2, size(_t) - 1)"), lambda a, b: F.xxhash64(a, b))
    df = df.select(*keep, F.when(F.size("_t") >= K, runs).when(F.size("_t") == 1, F.col("_t")).otherwise(F.array(F.xxhash64(text))).alias("_h"))
    # occurrence numbers: equal k-mers are neighbours in _p, and their places are in text order
    df = df.select(*keep, "_h", _sorted("_h", lambda h: h).alias("_p"))
    high = lambda i: F.shiftright(F.get("_p", i), 31)
    first = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: (i == 0) | (high(i) != high(i - 1)))
    df = df.select(*keep, "_h", "_p", first.alias("_b"))
    after = F.concat(F.expr("slice(_b, 2, size(_b))"), F.array(F.size("_p")))
    df = df.select(*keep, "_h", "_p", F.flatten(F.zip_with("_b", after, lambda a, b: F.sequence(F.lit(0), b - a - 1))).alias("_n"))
    df = df.select(*keep, "_p", F.zip_with("_p", "_n", lambda p, n: F.xxhash64(F.get("_h", _place(p)), n)).alias("_e"))

    def tuple_hash(ranks: Column) -> Column:
        least = F.transform(ranks, _place)
        in_text = F.sort_array(F.transform(least, lambda i: F.struct(_place(F.get("_p", i)).alias("i"), F.get("_e", i).alias("e"))))
        return F.xxhash64(F.transform(in_text, lambda x: x["e"])).bitwiseAND(F.lit(0xFFFFFFFF))

    done: list[str] = []
    for order in range(SIZE // 2):  # one order's ranks at a time
        df = df.select(*keep, "_p", "_e", *done, _sorted("_e", lambda e, order=order: F.xxhash64(e, F.lit(order))).alias("_r"))
        ends = [F.slice("_r", 1, TAKEN), F.slice("_r", F.greatest(F.size("_r") - (TAKEN - 1), F.lit(1)), TAKEN)]
        df = df.select(*keep, "_p", "_e", *done, *[tuple_hash(e).alias(f"_o{2 * order + k}") for k, e in enumerate(ends)])
        done += [f"_o{2 * order}", f"_o{2 * order + 1}"]
    return df.select(*keep, F.array(*done).alias(out))


def fingerprint(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of the places at which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SIZE))


def _constants(values: list, type_: str) -> Column:
    """A constant array, sent to the JVM as one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{type_}>")


def _bucket(col: str, bounds: list[int]) -> Column:
    """How many of the ascending bounds are above the value, counted in two steps: every ``step``-th one, then those in between."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, int(len(bounds) ** 0.5))
    some = F.size(F.filter(_constants(bounds[::step], "bigint"), lambda b: b <= F.col(col)))
    rest = F.size(F.filter(F.slice(_constants(bounds, "bigint"), F.greatest(some - 1, F.lit(0)) * step + 1, step), lambda b: b <= F.col(col)))
    return (F.lit(len(bounds)) - (F.greatest(some - 1, F.lit(0)) * step + rest)).cast("long")


def with_next(df: DataFrame, columns: list[str], tie: str = "text") -> DataFrame:
    """``df`` plus next_<c> for each of ``columns``: the value in the next row in descending doc_id."""
    buckets = max(1, min(MAX_BUCKETS, df.agg(F.count("doc_id")).first()[0] // ROWS_PER_BUCKET))
    bounds = []
    if buckets > 1:
        shares = _constants([i / buckets for i in range(1, buckets)], "double")
        bounds = df.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * buckets)).alias("x")).first()["x"]
    df = df.withColumn("_b", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64(tie), F.lit(buckets))).otherwise(_bucket("doc_id", sorted(set(bounds)))))
    tops = [tuple(r) for r in df.where("doc_id is not null").groupBy("_b").agg(F.max("doc_id")).orderBy("_b").collect()]  # MAX_BUCKETS rows at most
    bounds = [(b, top, tops[i - 1][0]) for i, (b, top) in enumerate(tops)]
    bound = df.sparkSession.createDataFrame(bounds, "_b long, _top long, _before long")
    both = df.join(F.broadcast(bound), "_b", "left")
    copies = F.when(F.col("doc_id") == F.col("_top"), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("x")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("x")))) \
        .otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("x"))))
    rows = both.select(*[c for c in df.columns if c != "_b"], F.explode(copies).alias("_c"))
    ahead = Window.partitionBy("_c.b").orderBy("_c.x", F.desc("doc_id"), tie)
    rows = rows.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in columns])
    return rows.where("_c.x = 0").drop("_c")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(with_signature(docs, "text", "sig"), ["text", "sig"])
    alone = F.col("doc_id").isNull()
    empty = with_signature(spark.range(1).select(F.lit("").alias("none")), "none", "sig").first()["sig"]
    both = both.select("doc_id", "text", "sig", F.when(alone, "").otherwise(F.col("next_text")).alias("next_text"),
                       F.when(alone, F.array(*map(F.lit, empty))).otherwise(F.col("next_sig")).alias("next_sig"))
    cut = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.left("next_text", cut))
    both = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    out = with_signature(both, "edited", "edited_sig")
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      fingerprint("sig").alias("fingerprint"), fingerprint("edited_sig").alias("edited_fingerprint"),
                      likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
