"""Line dedup: levelled sorted runs of line hashes.

A run is a written table (h, n): line hash and the number of documents that hold it, sorted by hash.
Documents arrive in batches.  A batch's hashes are merge-anti-joined with the runs of settled lines
(those already known to be in ``min_docs`` documents need no further counting), and the rest becomes
the batch's own run on level 0.  When a level holds ``FANOUT`` runs they are merged into one run of
the next level; lines that reach ``min_docs`` there move to a settled run.  After the last batch all
levels are merged once.  There is a batch for every ``BATCH_LINES`` lines, and never fewer than
``BATCHES`` (twice the fan-out, so that later batches meet settled lines and a second level is built at any size).

Dropping needs no line text in a shuffle: line hashes meet the settled hashes, the hit positions
return to their document, and the kept lines are joined again from the document's own text.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  Keys shorter than
``min_chars`` code points are never dropped.  Defined cases: null or empty text is one empty line; a
null id is a document like any other; each repeated row counts as a document of its own; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import BLANKS, ascii_lower, documents
from irforge.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 2
BATCHES = 2 * FANOUT
BATCH_LINES = 500_000_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, hs): one hash per line, null for keys that are too short to drop."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(F.transform(lines, line_key), lambda k: F.when(F.char_length(k) >= min_chars, F.xxhash64(k))).alias("hs"))


class LineRuns:
    """The runs of all batches so far."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None

    def add(self, hashes: DataFrame) -> None:
        """Add a batch: a frame with an array column hs for each document."""
        new = hashes.select(F.explode(F.array_distinct("hs")).alias("h")).where("h is not null")
        if self.settled is not None:
            new = new.join(self.settled, "h", "left_anti")
        self.levels[0].append(self._run(new.groupBy("h").agg(F.count(F.lit(1)).alias("n"))))
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                self._merge(i)

    def _run(self, df: DataFrame) -> DataFrame:
        return materialize(df.sortWithinPartitions("h"))

    def _merge(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self.levels[level][0]
        for r in self.levels[level][1:]:
            merged = merged.unionByName(r)
        merged = self._run(merged.groupBy("h").agg(F.sum("n").alias("n")))
        full = merged.where(F.col("n") >= self.min_docs).select("h")
        self.settled = self._run(full if self.settled is None else full.unionByName(self.settled))
        self.levels[level] = []
        self.levels[level + 1].append(merged.where(F.col("n") < self.min_docs))

    def frequent(self) -> DataFrame:
        """(h): hashes of the lines found in at least min_docs documents."""
        runs = [r for level in self.levels for r in level]
        self.levels = [runs]
        if runs:
            self._merge(0)
        return self._run(self.settled.distinct())


def frequent_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(h): hashes of the lines found in at least ``min_docs`` of the written ``hashes``, batch after batch."""
    if batches is None:
        lines = hashes.agg(F.sum(F.size("hs"))).first()[0] or 0
        batches = max(BATCHES, -(-lines // BATCH_LINES))
    runs = LineRuns(min_docs)
    batch = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches))
    for b in range(batches):
        runs.add(hashes.where(batch == b))
    return runs.frequent()


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int | None = None) -> DataFrame:
    """``docs`` with text rebuilt without frequent lines, plus n_lines and n_dropped (long).

    Input columns called n_lines, n_dropped, text_hash, text_lines, dropped, _line_doc or _line_text give way.
    """
    docs = docs.drop("n_lines", "n_dropped", "text_hash", "dropped", "text_lines", "_line_doc", "_line_text")
    hashes = materialize(line_hashes(docs, min_chars))
    frequent = frequent_lines(hashes, min_docs, batches)
    hits = hashes.select("doc_id", "text_hash", F.posexplode("hs").alias("pos", "h")).where("h is not null").join(frequent, "h")
    dropped = hits.groupBy(F.col("doc_id").alias("_line_doc"), F.col("text_hash").alias("_line_text")).agg(F.collect_set("pos").alias("dropped"))
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    both = keyed.join(dropped, keyed.doc_id.eqNullSafe(dropped._line_doc) & (keyed.text_hash == dropped._line_text), "left")
    both = both.withColumn("text_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("text_lines") - 1), "dropped")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("text_lines", i)), "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                       F.size("text_lines").cast("long").alias("n_lines"),
                       F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT t.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM t JOIN g ON t.rid = g.rid
"""
