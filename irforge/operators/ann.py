"""Approximate and late-interaction retrieval.

J16 (inverted-file top-k): about sqrt(N) cells, trained at two levels on a sample, and the documents written
as a table partitioned by cell, so a search reads the probed cells only.  The index grows with the
collection: cells, sample and broadcast centres with its square root, and a search with the share of cells that it
probes.  ``calibrate`` measures how many cells a recall takes on the data at hand, since that depends on how
much structure the vectors have.  With all cells probed the result is the exact top-k (J10).

M19 (MaxSim): for each (query, document) pair of a candidate run, the sum over query tokens of the
best document-token similarity (negative squared L2, as the reference's l2 setting).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from irforge.operators import similarity as sim
from irforge.operators import topk as tk
from irforge.operators.common import topk_per_group
from irforge.session import ensure_checkpoint_dir, materialize

#: Sampled vectors for each cell to be trained.
SAMPLE_PER_CELL = 64
#: Top-level groups whose cells are looked at when a document is assigned.
NEAR_GROUPS = 4
ITERATIONS = 20
#: Bytes of query vectors in a broadcast slice of the query set.
QUERY_BYTES = 32 << 20
#: Queries whose exact neighbours calibrate the number of probed cells.
CALIBRATION_QUERIES = 64


def lloyd(x: np.ndarray, k: int, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """At most k centres of a sample that fits a task; an empty cell keeps its centre."""
    distinct = np.unique(x, axis=0)
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(iterations):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        used = np.flatnonzero(n)
        moved = centers.copy()
        moved[used] = np.add.reduceat(x[order], (np.cumsum(n) - n)[used], axis=0) / n[used, None]
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own constant."""
    return (centers * centers).sum(axis=1) - 2 * (x @ centers.T)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return distances(x, centers).argmin(axis=1)


@dataclass
class Cells:
    """Two levels of centres: groups, and the cells of each (numbered through, group after group)."""
    groups: np.ndarray
    centers: np.ndarray
    group_of: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell among those of the nearest groups."""
        near = min(NEAR_GROUPS, len(self.groups))
        groups = np.argpartition(distances(x, self.groups), near - 1, axis=1)[:, :near]
        best, out = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
        for g in np.unique(groups).tolist():
            rows = np.flatnonzero((groups == g).any(axis=1))
            cells = np.flatnonzero(self.group_of == g)
            d = distances(x[rows], self.centers[cells])
            at = d.argmin(axis=1)
            low = d[np.arange(len(rows)), at]
            better = low < best[rows]
            best[rows[better]], out[rows[better]] = low[better], cells[at[better]]
        return out

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All cells of each row, nearest first."""
        return np.argsort(distances(x, self.centers), axis=1, kind="stable")


@dataclass
class IvfIndex:
    cells: Cells
    path: str
    spark: object

    def table(self, probed: list[int] | None = None) -> DataFrame:
        """(docid, vec, cell); only the folders of the probed cells are read."""
        t = self.spark.read.schema("docid string, vec array<double>, key long, cell int").parquet(self.path)
        return t if probed is None or len(probed) == len(self.cells.centers) else t.where(F.col("cell").isin(probed))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def train_cells(docs: DataFrame, n_cells: int, seed: int = 42, vec: str = "vec") -> Cells:
    """Groups from a part of the sample, then the cells of each group in a task of its own.

    The sample has ``SAMPLE_PER_CELL`` vectors for each cell (all, if there are fewer), the part for the groups as many for each group.
    """
    n_groups = max(1, round(n_cells ** 0.5))
    rank = F.xxhash64(F.lit(seed), "docid")
    rows = docs.count()
    share = min(1.0, 1.1 * SAMPLE_PER_CELL * n_cells / max(rows, 1))
    # a share of the hash range is a sample that needs no sort and comes out alike at any layout
    sample = materialize(docs.where(F.pmod(rank, F.lit(1 << 30)) < int(share * (1 << 30))).select("docid", F.col(vec).alias("vec")))
    few = sample.orderBy(rank, "docid").limit(SAMPLE_PER_CELL * n_groups).select("vec").toPandas()
    if few.empty:
        return Cells(np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1, dtype=np.int64))
    groups = lloyd(_stack(few["vec"]), n_groups, seed)
    sent = docs.sparkSession.sparkContext.broadcast(groups)
    per_cell = max(1.0, sample.count() / n_cells)

    def to_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": nearest(_stack(b["vec"]), sent.value), "vec": b["vec"]}) if len(b) else pd.DataFrame({"g": [], "vec": []})

    def cells_of(rows: pd.DataFrame) -> pd.DataFrame:
        x = _stack(rows["vec"])
        return pd.DataFrame({"g": int(rows["g"].iloc[0]), "center": lloyd(x, max(1, round(len(x) / per_cell)), seed).tolist()})

    found = sample.select("vec").mapInPandas(to_group, "g long, vec array<double>").groupBy("g").applyInPandas(cells_of, "g long, center array<double>").toPandas().sort_values("g", kind="stable")
    sent.destroy()
    return Cells(groups, _stack(found["center"]), found["g"].to_numpy(dtype=np.int64))


def ivf_index(docs: DataFrame, n_cells: int | None = None, seed: int = 42, vec: str = "vec") -> IvfIndex:
    """Cells of docs(docid, vec), sqrt(N) unless given, and the documents written by cell under the checkpoint folder, with a key in the order of their ids."""
    spark = docs.sparkSession
    n = docs.count()
    cells = train_cells(docs, n_cells or max(1, round(n ** 0.5)), seed, vec)
    sent = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=sent.value.assign(_stack(b["vec"])))

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/irforge-tables/ivf-{uuid.uuid4().hex}"
    rows = tk.in_order(docs.select(F.col("docid").cast("string").alias("rid"), F.col(vec).cast("array<double>").alias("vec")), n, cells.centers.shape[1])
    rows = rows.withColumnRenamed("rid", "docid").mapInPandas(assign, "docid string, vec array<double>, key long, cell int")
    # one writer for a cell, and several for a large one
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    sent.destroy()
    return IvfIndex(cells, path, spark)


def calibrate(queries: DataFrame, docs: DataFrame, index: IvfIndex, k: int, recall: float = 0.9, qvec: str = "qvec", vec: str = "vec") -> int:
    """The fewest probed cells with which ``CALIBRATION_QUERIES`` hash-chosen queries find ``recall`` of their exact top k."""
    some = materialize(queries.orderBy(F.xxhash64(F.lit(1), "qid"), "qid").limit(CALIBRATION_QUERIES).select("qid", F.col(qvec).alias("qvec")))
    exact = sim.topk(some, docs, k, left_id="qid", right_id="docid", left_vec="qvec", right_vec=vec).select(F.col("lid").alias("qid"), F.col("rid").alias("docid"))
    homes = materialize(exact).join(index.table().select("docid", "cell"), "docid").select("qid", "cell").toPandas()
    own = some.toPandas()
    if homes.empty:
        return len(index.cells.centers)
    ranked = index.cells.ranked(_stack(own["qvec"]))
    place = np.argsort(ranked, axis=1)
    at = {q: i for i, q in enumerate(own["qid"].astype(str))}
    needed = np.sort(place[[at[q] for q in homes["qid"].astype(str)], homes["cell"].to_numpy()])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def ivf_topk(queries: DataFrame, index: IvfIndex, k: int, nprobe: int, qvec: str = "qvec") -> DataFrame:
    """(qid, docid, score, rank): inner-product top-k over the documents of each query's ``nprobe`` nearest cells.

    Few queries go out in slices of at most ``QUERY_BYTES``; documents are scored where they lie, and the k best of each query and
    partition are shuffled.  When that is more than the index holds, a task takes a block of queries instead and the cells pass by
    (``topk.met``), so nothing is merged.  Equal scores (to 6 decimals) go by docid.
    """
    spark = queries.sparkSession
    dim = index.cells.centers.shape[1]
    nprobe = min(nprobe, len(index.cells.centers))
    q = materialize(queries.select(F.col("qid").cast("string").alias("lid"), F.col(qvec).cast("array<double>").alias("lvec")))
    n, docs = q.count(), index.table().count()
    if n * k * sim.RESULT_BYTES * max(spark.sparkContext.defaultParallelism, docs * dim * 8 >> 27) > docs * dim * 8 * nprobe / len(index.cells.centers):
        blocks = materialize(tk.packed(index.table().select(F.col("docid").alias("rid"), F.col("vec").alias("rvec"), "key", "cell"), tk.rows_of_block(dim)))
        sent = spark.sparkContext.broadcast(index.cells)

        def meet(block: tk.Left, rows: pa.Table) -> None:
            if block.asks is None:
                block.asks = asking(sent.value, block.x, nprobe)
            search(block.best, block.asks, rows["rid"].combine_chunks(), tk.matrix(rows["rvec"]), rows["key"].to_numpy(), rows["cell"].to_numpy())

        return tk.met(tk.packed(tk.left_blocks(q, n), tk.MOST_ROWS), blocks, k, meet).toDF("qid", "docid", "score", "rank")
    slices = max(1, -(-n * dim * 8 // QUERY_BYTES))
    out = None
    for i in range(slices):
        own = q.where(F.pmod(F.xxhash64("lid"), F.lit(slices)) == i).toArrow()
        x = tk.matrix(own["lvec"]) if own.num_rows else np.zeros((0, dim))
        one = _score(index, own["lid"].to_numpy(), x, asking(index.cells, x, nprobe), k)
        out = one if out is None else out.unionByName(one)
    return topk_per_group(out, ["qid"], [F.desc("score"), F.asc("docid")], k, split_col="docid")


def asking(cells: Cells, x: np.ndarray, nprobe: int) -> np.ndarray:
    """Whether a cell (row) is among the ``nprobe`` nearest of a query (column)."""
    out = np.zeros((len(cells.centers), len(x)), dtype=bool)
    for at in range(0, len(x), 1024):
        near = cells.ranked(x[at:at + 1024])[:, :nprobe]
        out[near, np.arange(at, at + len(near))[:, None]] = True
    return out


def search(best: tk.Best, asks: np.ndarray, ids: pa.Array, y: np.ndarray, key: np.ndarray, cell: np.ndarray) -> None:
    """Documents of any cells, for the queries that probe these."""
    order = np.argsort(cell, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        if len(rows):
            best.add(y[rows], key[rows], ids.take(pa.array(rows)), np.flatnonzero(asks[cell[rows[0]]]))


def _score(index: IvfIndex, qids: np.ndarray, x: np.ndarray, asks: np.ndarray, k: int) -> DataFrame:
    sent = index.spark.sparkContext.broadcast((qids, x, asks))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, x, asks = sent.value
        # one after another, so that a block's row numbers fit
        blocks = [(at, tk.Best(x[at:at + tk.MOST_ROWS], k)) for at in range(0, len(x), tk.MOST_ROWS)]
        for b in batches:
            if b.num_rows:
                for at, best in blocks:
                    search(best, asks[:, at:at + tk.MOST_ROWS], b.column(0), tk.matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy())
        for at, best in blocks:
            q, points, ids = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(qids[at + q], pa.string()), ids, pa.array(points)], names=["qid", "docid", "score"])

    probed = np.flatnonzero(asks.any(axis=1)).tolist()
    return materialize(index.table(probed).select("docid", "vec", "key", "cell").mapInArrow(score, "qid string, docid string, score double"))


def packed_tokens(tokens: DataFrame, id_col: str, vec: str, out: str) -> DataFrame:
    """(id, out): the token vectors of an id in one array, vector after vector; bounded by the token limit of a text."""
    return tokens.where(F.col(vec).isNotNull()).groupBy(id_col).agg(F.flatten(F.collect_list(F.col(vec).cast("array<double>"))).alias(out), F.count(F.lit(1)).alias(f"{out}_n"))


@F.pandas_udf(DoubleType())
def _token_score(q: pd.Series, qn: pd.Series, d: pd.Series, dn: pd.Series) -> pd.Series:
    out = []
    for x, n, y, m in zip(q, qn, d, dn):
        x, y = np.asarray(x).reshape(n, -1), np.asarray(y).reshape(m, -1)
        far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
        out.append(-float(np.maximum(far.min(axis=1), 0.0).sum()))
    return pd.Series(out, dtype="float64")


def maxsim(pairs: DataFrame, qtok: DataFrame, dtok: DataFrame, id_col: str = "docid") -> DataFrame:
    """(qid, docid, maxsim) = Σ_q-token max_d-token (−|q − d|²) over masked-in tokens.

    ``pairs``: (qid, docid); ``qtok``: (qid, qpos, qv); ``dtok``: (docid, dpos, dv, mask).  Tokens are packed into one
    matrix for each text, and a pair is one row with two matrices and one product.  A pair without tokens on a side
    has no row.
    """
    q = packed_tokens(qtok, "qid", "qv", "_q")
    d = packed_tokens(dtok.where(F.col("mask") == 1), id_col, "dv", "_d")
    scored = pairs.join(q, "qid").join(d, id_col)
    return scored.select("qid", id_col, _token_score("_q", "_q_n", "_d", "_d_n").alias("maxsim"))
