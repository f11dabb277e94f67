"""Exact inner-product top-k of many rows against many.

A task holds a block of left rows and meets all right rows, so the k best of a left row leave it as they are and nothing is
merged afterwards.  A small right side is sent to all workers; a larger one is packed into blocks, written once and streamed past each
block of left rows (Spark's cartesian product with the left block as its buffered side), so a task holds one left block, the k best
of its rows and one run of right blocks.

Products are done in single precision, and only pairs that may belong to the k best by a bound of its error are scored again in
double precision; scores are rounded to 6 decimals and equal ones go by the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irforge.session import materialize

#: Left rows of a task on average, and at most at once (row numbers have 16 bits).
LEFT_ROWS = 8192
MOST_ROWS = 16384
#: Bytes of vectors in a packed block.
BLOCK_BYTES = 8 << 20
#: Rows on either side of one product.
STEP = (512, 2048)
#: Pairs that are scored in double precision at once.
EXACT = 1 << 14
#: A row with more than so many times k candidates is sorted by itself.
CROWD = 4
SCHEMA = "lid string, rid string, score double, rank bigint"


class Best:
    """The k best right rows of each group of left rows so far; a right row is known by a key in the order of its id."""

    def __init__(self, x: np.ndarray, k: int, group: np.ndarray | None = None):
        self.x, self.k, self.norm = x, k, _norms(x)
        self.group = np.arange(len(x), dtype=np.uint16) if group is None else group.astype(np.uint16)
        self.n = int(self.group.max()) + 1 if len(x) else 0
        self.low, self.least = None, np.full(self.n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting, self.room = 0, np.empty(STEP[0] * STEP[1], dtype=np.float32)

    def add(self, y: np.ndarray, key: np.ndarray, ids: pa.Array, rows: np.ndarray | None = None) -> None:
        """Right rows, for the left rows ``rows`` if given."""
        if not len(y) or not self.n or (rows is not None and not len(rows)):
            return
        reach = _norms(y).max()
        single = max(reach, self.norm.max(), reach * self.norm.max()) < 1e30
        if single and self.low is None:
            self.low = self.x.astype(np.float32)
        mine, other = (self.low, y.astype(np.float32)) if single else (self.x, y)
        # of a product's terms, each factor and each partial sum is rounded once
        slack = self.norm * reach * (y.shape[1] + 8) * (2.0 ** -24 if single else 2.0 ** -53) + 1e-6
        whole = np.arange(len(self.x)) if rows is None else rows
        for j in range(0, len(other), STEP[1]):
            right = other[j:j + STEP[1]].T
            for i in range(0, len(whole), STEP[0]):
                at = whole[i:i + STEP[0]]
                left = mine[at[0]:at[-1] + 1] if at[-1] - at[0] == len(at) - 1 else mine[at]
                s = np.matmul(left, right, out=self.room[:len(at) * right.shape[1]].reshape(len(at), -1)) if single else left @ right
                floor = self.least[self.group[at]] - slack[at]
                new = np.flatnonzero(np.isneginf(floor))
                if len(new) and s.shape[1] > self.k:
                    floor[new] = np.nan_to_num(np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k], nan=-np.inf, posinf=np.inf, neginf=-np.inf) - 2 * slack[at[new]]
                if single:
                    floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
                hit = np.flatnonzero(s >= floor[:, None])
                if len(hit):
                    self._take(at[hit // s.shape[1]], j + hit % s.shape[1], y, key, ids)
            if self.waiting > max(self.n * self.k // 2, 1 << 12):
                self.settle()

    def _take(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, key: np.ndarray, ids: pa.Array) -> None:
        score = np.concatenate([np.round((self.x[i[a:a + EXACT]] * y[j[a:a + EXACT]]).sum(1), 6) for a in range(0, len(i), EXACT)])
        good = score >= self.least[self.group[i]]
        i, j, score = i[good], j[good], score[good]
        self.parts.append((self.group[i], key[j], score, ids.take(pa.array(j))))
        self.waiting += len(i)

    def settle(self) -> None:
        """Cut the candidates to the k best of each group by score and key."""
        if not self.parts:
            return
        group, key, score = (np.concatenate([p[c] for p in self.parts]) for c in range(3))
        ids = pa.concat_arrays([p[3] for p in self.parts])
        order = np.argsort(group, kind="stable")
        group, key, score = group[order], key[order], score[order]
        n = np.bincount(group, minlength=self.n)
        start = np.cumsum(n) - n
        keep = np.ones(len(group), dtype=bool)
        light = np.flatnonzero((n > self.k) & (n <= CROWD * self.k))
        if len(light):
            number = np.full(self.n, -1)
            number[light] = np.arange(len(light))
            at = np.flatnonzero(number[group] >= 0)
            own, width = number[group[at]], n[light].max()
            grid = np.full((len(light), width), -np.inf)
            grid[own, at - start[group[at]]] = score[at]
            grid.partition(width - self.k, axis=1)
            last = grid[:, width - self.k]
            over, tie = score[at] > last[own], score[at] == last[own]
            keep[at] = over | tie
            left = self.k - np.bincount(own[over], minlength=len(light))
            crowded = np.bincount(own[tie], minlength=len(light)) > left
            some = np.flatnonzero(tie & crowded[own])
            some = some[np.lexsort((key[at[some]], own[some]))]
            keep[at[some[_places(own[some]) >= left[own[some]]]]] = False
        some = np.flatnonzero(n[group] > CROWD * self.k)
        some = some[np.lexsort((key[some], -score[some], group[some]))]
        keep[some[_places(group[some]) >= self.k]] = False
        group, key, score = group[keep], key[keep], score[keep]
        first = np.flatnonzero(np.diff(group, prepend=np.uint16(0)) != 0)
        first = first if len(group) == 0 or (len(first) and first[0] == 0) else np.r_[0, first]
        if len(group):
            full = np.diff(np.r_[first, len(group)]) >= self.k
            self.least[group[first][full]] = np.minimum.reduceat(score, first)[full]
        self.parts = [(group, key, score, ids.take(pa.array(order[keep])))]
        self.waiting = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(group, score, id), best first in each group."""
        self.settle()
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0), pa.array([], pa.string())
        group, key, score, ids = self.parts[0]
        order = np.lexsort((key, -score, group))
        return group[order].astype(np.int64), score[order], ids.take(pa.array(order))


def _norms(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    return np.where(np.isfinite(norm), norm, 0.0) if np.isfinite(norm).all() else np.where(np.isfinite(norm), norm, np.finfo(np.float64).max ** 0.25)


def _places(sorted_groups: np.ndarray) -> np.ndarray:
    """Each row's place in its run of equal values."""
    return np.arange(len(sorted_groups)) - np.searchsorted(sorted_groups, sorted_groups, "left")


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    dim = len(values) // max(1, len(vectors))
    if vectors.null_count or (len(vectors) and (pc.list_value_length(vectors).to_numpy(zero_copy_only=False) != dim).any()):
        raise ValueError("vectors of one length are needed")
    return values.reshape(len(vectors), dim)


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unstream(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """(data): runs of at most ``block_rows`` rows of a partition as Arrow streams."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == block_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([_stream(pa.Table.from_batches(held))], pa.binary())], names=["data"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_stream(pa.Table.from_batches(held))], pa.binary())], names=["data"])

    return rows.mapInArrow(pack, "data binary")


def rows_of_block(dim: int) -> int:
    return max(64, min(LEFT_ROWS, BLOCK_BYTES // (8 * max(1, dim))))


def left_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Left rows (lid first) dealt out by id, so that rows of one id meet in a task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(-(-n // LEFT_ROWS), min(2 * cores, -(-n // 256)), 1), "lid")


def in_order(rows: DataFrame, n: int, dim: int) -> DataFrame:
    """``rows`` with a key (long) in the order of the column rid."""
    files = max(1, -(-n * max(1, dim) * 8 // (8 * BLOCK_BYTES)), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)))
    return rows.repartitionByRange(files, "rid").sortWithinPartitions("rid").withColumn("key", F.monotonically_increasing_id())


class Left:
    """A block of left rows and its k best."""

    def __init__(self, rows: pa.Table, k: int):
        lid = rows["lid"].combine_chunks()
        group, first = pd.factorize(lid.to_pandas(), use_na_sentinel=False)
        self.lid, self.x = pa.array(first, pa.string(), from_pandas=True), matrix(rows["lvec"])
        self.best, self.asks = Best(self.x, k, group), None

    def out(self) -> pa.Table:
        group, score, rid = self.best.rows()
        return pa.table({"lid": self.lid.take(pa.array(group)), "rid": rid, "score": score, "rank": pa.array(_places(group) + 1)})


def listed(blocks: list[Left], k: int) -> Iterator[pa.RecordBatch]:
    """The rows of all blocks of a task; ids that lie in several blocks are merged."""
    out = pa.concat_tables([b.out() for b in blocks])
    if len(blocks) > 1 and sum(len(b.lid) for b in blocks) > len(pc.unique(pa.chunked_array([b.lid for b in blocks]))):
        rows = out.to_pandas().sort_values(["score", "rid"], ascending=[False, True], kind="stable")
        rows = rows.groupby("lid", sort=False, dropna=False).head(k)
        rows["rank"] = rows.groupby("lid", sort=False, dropna=False).cumcount() + 1
        out = pa.Table.from_pandas(rows, schema=out.schema, preserve_index=False)
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def held_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Left]:
    """The left rows of a task in blocks of at most ``MOST_ROWS``."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, MOST_ROWS - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == MOST_ROWS:
                yield Left(pa.Table.from_batches(held), k)
                held, n = [], 0
    if held:
        yield Left(pa.Table.from_batches(held), k)


def met(left: DataFrame, blocks: DataFrame, k: int, meet) -> DataFrame:
    """``meet(block of left rows, right table)`` for every packed block of either side, a task for each partition of ``left``."""
    stream = blocks.coalesce(1).select(F.monotonically_increasing_id().alias("n"), F.col("data").alias("rdata"))
    own = left.select(F.monotonically_increasing_id().alias("lb"), F.col("data").alias("ldata"))
    # the right blocks pass by, a partition of left blocks is buffered and handed on with the first of them only
    pairs = stream.hint("shuffle_replicate_nl").crossJoin(own).select("lb", F.when(F.col("n") == 0, F.col("ldata")).alias("ldata"), "rdata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Left] = {}
        for batch in batches:
            for lb, ldata, rdata in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if lb not in mine:
                    mine[lb] = Left(_unstream(ldata), k)
                meet(mine[lb], _unstream(rdata))
        if mine:
            yield from listed(list(mine.values()), k)

    return pairs.mapInArrow(run, SCHEMA)


def topk(left: DataFrame, right: DataFrame, k: int, n: int, m: int, dim: int, small: int) -> DataFrame:
    """(lid, rid, score, rank) for left(lid, lvec) of n rows and right(rid, rvec) of m rows, sent out if its vectors take no more than ``small`` bytes."""
    spark = left.sparkSession
    if m * max(1, dim) * 8 <= small:
        rows = right.toArrow()
        rows = rows.take(pc.sort_indices(rows, [("rid", "ascending")], null_placement="at_start"))
        sent = spark.sparkContext.broadcast((rows["rid"].combine_chunks(), matrix(rows["rvec"])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rid, y = sent.value
            done = []
            for block in held_blocks(batches, k):
                block.best.add(y, np.arange(len(y)), rid)
                done.append(block)
            if done:
                yield from listed(done, k)

        return left_blocks(left, n).mapInArrow(run, SCHEMA)
    blocks = materialize(packed(in_order(right, m, dim), rows_of_block(dim)))

    def meet(block: Left, rows: pa.Table) -> None:
        block.best.add(matrix(rows["rvec"]), rows["key"].to_numpy(), rows["rid"].combine_chunks())

    return met(packed(left_blocks(left, n), MOST_ROWS), blocks, k, meet)
