"""Vector code compression: a codebook for each part of the vectors, trained by active-entry Lloyd rounds.

Every vector is cut into equal parts; a part's code is the nearest entry of its position's codebook, the
lower index if two are as near.  The state of a round (codes and exact distances) is a written table that
the next round reads.  After an update only some entries have moved.  A part whose entry stayed where
it was keeps its stored distance, which is still exact, and is compared with the moved entries alone: among the
entries that did not move its own is still the nearest with the lowest index.  All other parts
are compared with the whole codebook.

The driver holds the codebooks (parts x entries x width integers, fixed by the parameters); a task hands
on one row of sums for each entry that it used.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; the length of
the vectors is that of the smallest vec_id whose vector can be cut into equal parts that are not empty, and vectors of another length are
dropped too; null ids come after all others, and rows of one id in ascending order of their components;
fewer rows than entries give as many entries as rows; repeated rows are coded each; an empty table gives
an empty result; a component whose integer is so large that squared distances don't fit a long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.integer_vectors import complete, integers, matrix, rows_of, summed
from irforge.session import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors that are compared at a time.
ROWS = 4096


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, the lower index if two are as near."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def recode(x: np.ndarray, code: np.ndarray, distance: np.ndarray, book: np.ndarray, moved: np.ndarray) -> int:
    """Codes and distances of one part position, updated in place; returns how many distances were computed."""
    stale = moved[code]
    rescan, active = np.flatnonzero(stale), np.flatnonzero(moved)
    if len(rescan):
        code[rescan], distance[rescan] = nearest(x[rescan], book)
    rest = np.flatnonzero(~stale)
    if len(rest) and len(active):
        at, d = nearest(x[rest], book[active])
        at = active[at]
        better = (d < distance[rest]) | ((d == distance[rest]) & (at < code[rest]))
        code[rest[better]], distance[rest[better]] = at[better], d[better]
    return len(rescan) * len(book) + len(rest) * len(active)


def kept_vectors(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """((vec_id, label, v), length of the vectors), written once."""
    whole = vectors.where(complete("embedding") & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    dims = first.n if first else parts
    return materialize(whole.where(F.size("embedding") == dims).select("vec_id", "label", integers("embedding", scale, dims).alias("v"))), dims


def _cut(column: pa.Array, parts: int, dims: int) -> np.ndarray:
    """The vectors as an array [part, row, component]."""
    return np.ascontiguousarray(matrix(column, dims).reshape(-1, parts, dims // parts).transpose(1, 0, 2))


class Codebooks:
    """Entries by part position, and which of them the last update moved (all, at first)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.moved = np.ones(entries.shape[:2], dtype=bool)

    def update(self, sums: list) -> None:
        new = self.entries.copy()
        for r in sums:
            new[r.part, r.entry] = [int(r[f"s{i}"]) // int(r.n) for i in range(new.shape[2])]
        self.moved = (new != self.entries).any(axis=2)
        self.entries = new


def recoded(state: DataFrame, books: Codebooks) -> DataFrame:
    """The next state (vec_id, label, v, code, distance), written; rows without codes yet are compared with all entries."""
    parts, _, width = books.entries.shape
    dims = parts * width
    coded = "code" in state.columns
    sent = state.sparkSession.sparkContext.broadcast((books.entries, books.moved))

    def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, moved = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = _cut(b.column(2), parts, dims)
                if coded:
                    code = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).astype(np.int64).reshape(-1, parts).T.copy()
                    distance = matrix(b.column(4), parts).T.copy()
                    for p in range(parts):
                        recode(x[p], code[p], distance[p], entries[p], moved[p])
                else:
                    found = [nearest(x[p], entries[p]) for p in range(parts)]
                    code, distance = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                raw = [c.tobytes() for c in code.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.binary()), rows_of(distance.T)], names=["vec_id", "label", "v", "code", "distance"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    out = materialize(state.mapInArrow(code_rows, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<long>, code binary, distance array<long>"))
    sent.destroy()
    return out


def entry_sums(state: DataFrame, shape: tuple[int, int, int]) -> list:
    """Rows (part, entry, n, s0, s1 ..) of the used entries."""
    parts, entries, width = shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, dtype=np.int64)
        s = np.zeros((parts * entries, width), dtype=np.int64)
        for b in batches:
            x = _cut(b.column(0), parts, parts * width).reshape(-1, width)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            slot = (code.T.astype(np.int64) + np.arange(parts)[:, None] * entries).ravel()
            order = np.argsort(slot, kind="stable")
            used, at = np.unique(slot[order], return_index=True)
            if len(used):
                s[used] += np.add.reduceat(x[order], at, axis=0)
                n += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used // entries), pa.array(used % entries), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    return summed(state.select("v", "code").mapInArrow(sums, "part long, entry long, n long, s array<long>"), ["part", "entry"], width).collect()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code binary, distance of each part), codebooks [part, entry, component]) of vectors(vec_id, embedding, label)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    kept, dims = kept_vectors(vectors.select("vec_id", "embedding", "label"), parts, scale)
    start = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not start:
        return kept.selectExpr("vec_id", "label", "cast(null AS binary) AS code", "cast(null AS array<long>) AS distance"), np.empty((parts, 0, dims // parts), dtype=np.int64)
    books = Codebooks(np.array(start, dtype=np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy())
    state = recoded(kept, books)
    for _ in range(rounds):
        books.update(entry_sums(state, books.entries.shape))
        state = recoded(state, books)
    return state.drop("v"), books.entries


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = materialize(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), F.aggregate("distance", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")))
    by_label = materialize(rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, every part against every entry; d * ENTRIES + index orders by distance, then index."""
    text = f"""
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (
  SELECT rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM whole
  WHERE len(embedding) = (SELECT len(embedding) FROM whole ORDER BY vec_id NULLS LAST, embedding LIMIT 1)),
cell AS MATERIALIZED (SELECT rid, (j - 1) // (len(v) // {PARTS}) AS p, (j - 1) % (len(v) // {PARTS}) AS i, v[j] AS x FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS j FROM kept)),
c0 AS MATERIALIZED (
  SELECT p, e, i, x FROM cell JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) USING (rid)),"""
    for r in range(ROUNDS + 1):
        text += f"""
a{r} AS MATERIALIZED (
  SELECT rid, p, min(key) % {ENTRIES} AS e, min(key) // {ENTRIES} AS d
  FROM (SELECT rid, p, sum((s.x - q.x) * (s.x - q.x)) * {ENTRIES} + q.e AS key FROM cell s JOIN c{r} q USING (p, i) GROUP BY rid, p, q.e) GROUP BY rid, p),"""
        if r < ROUNDS:
            text += f"""
c{r + 1} AS MATERIALIZED (
  SELECT q.p, q.e, q.i, coalesce(m.x, q.x) AS x FROM c{r} q LEFT JOIN
  (SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM cell JOIN a{r} USING (rid, p) GROUP BY p, e, i) m USING (p, e, i)),"""
    return text + f"""
coded AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, sum(d) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)"""


SQL = _sql()
