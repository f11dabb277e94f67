"""Lloyd's k-means for many models at once (M2, M3): every K of a grid and every start in the same passes.

An iteration is one job whatever the number of models (one for each ``CENTER_BYTES`` of centres): a task adds up its rows' vectors by (model, cell) of the nearest
centre, the partial sums of a key meet in one task, and at most the sum of all K rows come back as the next
centres.  A model leaves the passes once none of its centres moves by more than ``tol``.  Ties go to the lower cell; an empty
cell keeps its centre.  A model starts from rows of one pool, which is read once and holds ``POOL`` x (largest K) x (starts)
rows at most, the first in the order of a seeded hash: start i takes the first K rows of its i-th stretch (``spread`` off,
wrapping round in a small table), or rows drawn in proportion to their squared distance to those drawn before (on).
Rows that a worker can hold are fitted model by model instead (``best``): a task draws a model's start and runs all its iterations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.session import materialize

#: Distances held at once by a task: rows of a step times centres.
CELLS = 1 << 20
#: Bytes of centres that are sent out, and come back, at once; more models take several passes an iteration.
CENTER_BYTES = 128 << 20
#: Rows of the pool for each centre of a start.
POOL = 4
#: Rows of the pool that a draw looks at together.
DRAW_ROWS = 512
#: A pool of more rows is drawn from in turns of at most ``TURN`` centres; a squared distance of less than this part of the squares is none.
TURN_POOL, TURN, SAME = 1 << 14, 256, 1e-13
#: Rows and centres of one product.
NEAR_STEP = (512, 2048)
#: Bytes of vectors that a task may hold to fit a model by itself.
HELD_BYTES = 128 << 20


@dataclass
class Fitted:
    k: int
    start: int
    centers: np.ndarray
    cost: float = np.inf  # squared distances to the centres before the last update
    iterations: int = 0


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and squared distance of each row."""
    cell, dist = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    own, step = (centers * centers).sum(axis=1), max(1, CELLS // len(centers))
    twice = -2.0 * centers.T
    for at in range(0, len(x), step):
        d = x[at:at + step] @ twice
        d += own
        best = d.argmin(axis=1)
        cell[at:at + step] = best
        dist[at:at + step] = d[np.arange(len(d)), best]
    return cell, np.maximum(dist + (x * x).sum(axis=1), 0.0)


def drawn(pool: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """Numbers of k rows: the first at random, each further one in proportion to the squared distance to the nearest before."""
    chosen = [int(rng.integers(len(pool)))]
    least, room = np.full(len(pool), np.inf), np.empty((DRAW_ROWS, pool.shape[1]))
    while len(chosen) < k:
        last = pool[chosen[-1]]
        for at in range(0, len(pool), DRAW_ROWS):
            part = least[at:at + DRAW_ROWS]
            d = np.subtract(pool[at:at + DRAW_ROWS], last, out=room[:len(part)])
            np.minimum(part, np.einsum("ij,ij->i", d, d), out=part)
        up_to = np.cumsum(least)
        if up_to[-1] > 0:
            chosen.append(min(int(np.searchsorted(up_to, rng.random() * up_to[-1], side="right")), len(pool) - 1))
        else:
            chosen.append(int(rng.integers(len(pool))))
    return chosen


def drawn_in_turns(pool: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """The same draw over a large pool: rows are proposed by the distances of the last turn and taken with the part of it that is
    left, which gives each row its own chance; a turn's centres then lower all distances in one product."""
    square = (pool * pool).sum(axis=1)
    chosen, least, done = [int(rng.integers(len(pool)))], np.full(len(pool), np.inf), 0
    while True:
        new = np.array(chosen[done:])
        twice, own = 2.0 * pool[new].T, square[new]
        for at in range(0, len(pool), DRAW_ROWS):
            near, mine = pool[at:at + DRAW_ROWS] @ twice, square[at:at + DRAW_ROWS]
            near -= own
            d = mine - near.max(axis=1)
            d[d <= SAME * mine] = 0.0
            np.minimum(least[at:at + DRAW_ROWS], d, out=least[at:at + DRAW_ROWS])
        done = len(chosen)
        if done >= k:
            return chosen
        up_to = np.cumsum(least)
        turn = max(1, min(TURN, done // 8, k - done))
        for _ in range(4 * turn):
            if not up_to[-1] > 0:
                chosen.append(int(rng.integers(len(pool))))
            else:
                row = min(int(np.searchsorted(up_to, rng.random() * up_to[-1], side="right")), len(pool) - 1)
                fresh = chosen[done:]
                left = min(least[row], ((pool[fresh] - pool[row]) ** 2).sum(axis=1).min()) if fresh else least[row]
                if rng.random() * least[row] < left:
                    chosen.append(row)
            if len(chosen) - done == turn:
                break


def closer(x: np.ndarray, low: np.ndarray | None, norm: np.ndarray, rows: np.ndarray, centers: np.ndarray, numbers: np.ndarray, cell: np.ndarray, far: np.ndarray) -> None:
    """Give ``rows`` a centre of ``centers`` where it is nearer than their own, or as near with a lower number; ``far`` leaves out a row's own square.

    Products are done in single precision if ``low`` is given; what may be nearer by a bound of its error is compared in double precision.
    """
    own = (centers * centers).sum(axis=1)
    mine, other = (x, centers) if low is None else (low, centers.astype(np.float32))
    half = (own / 2).astype(mine.dtype)
    reach = np.sqrt(own.max())
    slack = (norm * reach + own.max()) * (x.shape[1] + 8) * (2.0 ** -53 if low is None else 2.0 ** -24)
    for j in range(0, len(centers), NEAR_STEP[1]):
        right, less = other[j:j + NEAR_STEP[1]].T, half[j:j + NEAR_STEP[1]]
        for i in range(0, len(rows), NEAR_STEP[0]):
            at = rows[i:i + NEAR_STEP[0]]
            s = mine[at] @ right
            s -= less
            floor = -far[at] / 2 - slack[at]
            new = np.flatnonzero(np.isneginf(floor))
            if len(new):
                floor[new] = s[new].max(axis=1) - 2 * slack[at[new]]
            p, q = np.divmod(np.flatnonzero(s >= np.nextafter(floor.astype(s.dtype), s.dtype.type(-np.inf))[:, None]), s.shape[1])
            if not len(p):
                continue
            p, q = at[p], j + q
            d = own[q] - 2.0 * (x[p] * centers[q]).sum(axis=1)
            order = np.lexsort((numbers[q], d, p))
            order = order[np.flatnonzero(np.diff(p[order], prepend=-1))]
            p, d, q = p[order], d[order], numbers[q[order]]
            better = (d < far[p]) | ((d == far[p]) & (q < cell[p]))
            cell[p[better]], far[p[better]] = q[better], d[better]


def lloyd(x: np.ndarray, low: np.ndarray | None, centers: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """Centres, cost and iterations of one model on rows that a task holds.

    A row whose centre came no farther compares only with the centres that moved: the others are as far as they were, and were no nearer.
    """
    square = (x * x).sum(axis=1)
    norm, every = np.sqrt(square), np.arange(len(x))
    cell, far = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    closer(x, low, norm, every, centers, np.arange(len(centers)), cell, far)
    i = 0
    while True:
        i += 1
        cost = float(np.maximum(far + square, 0.0).sum())
        order = np.argsort(cell, kind="stable")
        used, first = np.unique(cell[order], return_index=True)
        new = centers.copy()
        new[used] = np.add.reduceat(x[order], first, axis=0) / np.diff([*first, len(x)])[:, None]
        shift = np.sqrt(((new - centers) ** 2).sum(axis=1)).max()
        if shift <= tol or i >= max_iter:
            return new, cost, i
        moved = (new != centers).any(axis=1)
        centers, before = new, far
        far = np.where(moved[cell], (centers * centers).sum(axis=1)[cell] - 2.0 * (x * centers[cell]).sum(axis=1), before)
        away = far > before
        lost = np.flatnonzero(away)
        closer(x, low, norm, lost, centers, np.arange(len(centers)), cell, far)
        closer(x, low, norm, np.flatnonzero(~away), centers[moved], np.flatnonzero(moved), cell, far)


def _cheapest(models: list[Fitted]) -> list[Fitted]:
    """The cheapest model of each K, the first of equal ones."""
    return [min((m for m in models if m.k == k), key=lambda m: (m.cost, m.start)) for k in dict.fromkeys(m.k for m in models)]


def _held_fit(df: DataFrame, specs: list[tuple[int, int]], pool: np.ndarray, seed: int, max_iter: int, tol: float) -> list[Fitted]:
    """The cheapest model of each K: a task draws and fits one model on the whole pool, the longest first, and only the centres of the cheapest come to the driver."""
    ks, specs = list(dict.fromkeys(k for k, _ in specs)), sorted(specs, key=lambda s: (-s[0], s[1]))
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((pool, specs))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, wanted = sent.value
        low = rows.astype(np.float32) if np.abs(rows).max() < 1e15 else None
        for m in (m for batch in batches for m in batch["id"].tolist()):
            k, i = wanted[m]
            centers, cost, n = lloyd(rows, low, rows[spread_rows(rows, k, np.random.default_rng([seed, i, k]))], max_iter, tol)
            yield pd.DataFrame({"model": [m], "cost": [cost], "iterations": [n], "centers": [centers.tobytes()]})

    fitted = materialize(spark.range(0, len(specs), 1, len(specs)).mapInPandas(one, "model long, cost double, iterations int, centers binary"))
    sent.destroy()
    cost = {r["model"]: r["cost"] for r in fitted.select("model", "cost").collect()}
    best = [min((m for m in cost if specs[m][0] == k), key=lambda m: (cost[m], specs[m][1])) for k in ks]
    rows = {r["model"]: r for r in fitted.where(F.col("model").isin(best)).toLocalIterator()}
    return [Fitted(specs[m][0], specs[m][1], np.frombuffer(rows[m]["centers"]).reshape(-1, pool.shape[1]).copy(), cost[m], rows[m]["iterations"]) for m in best]


def spread_rows(pool: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """Spread starts; a small pool is gone through once for each."""
    return drawn(pool, k, rng) if len(pool) <= TURN_POOL else drawn_in_turns(pool, k, rng)


def _pool(df: DataFrame, n: int, seed: int, vec: str, id_col: str) -> np.ndarray:
    return _rows(df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).select(F.col(vec).cast("array<double>").alias(vec)).limit(n).toPandas()[vec])


def _drawn_starts(spark: SparkSession, pool: np.ndarray, specs: list[tuple[int, int]], seed: int) -> list[Fitted]:
    """A task for each model, the longest first; the pool goes to all of them and only row numbers come back."""
    longest = sorted(range(len(specs)), key=lambda m: -specs[m][0])
    sent = spark.sparkContext.broadcast((pool, specs, longest))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, wanted, order = sent.value
            for m in (order[at] for at in batch["id"].tolist()):
                k, i = wanted[m]
                yield pd.DataFrame({"model": [m], "chosen": [spread_rows(rows, k, np.random.default_rng([seed, i, k]))]})

    chosen = {r["model"]: r["chosen"] for r in spark.range(0, len(specs), 1, len(specs)).mapInPandas(draw, "model long, chosen array<long>").collect()}
    sent.destroy()
    return [Fitted(k, i, pool[chosen[m]]) for m, (k, i) in enumerate(specs)]


def starts(df: DataFrame, specs: list[tuple[int, int]], seed: int, vec: str, id_col: str, spread: bool = False) -> list[Fitted]:
    most, n_starts = max(k for k, _ in specs), 1 + max(i for _, i in specs)
    pool = _pool(df, POOL * most * n_starts, seed, vec, id_col)
    if spread:
        return _drawn_starts(df.sparkSession, pool, specs, seed)
    return [Fitted(k, i, np.take(pool, np.arange(i * most, i * most + min(k, len(pool))), axis=0, mode="wrap")) for k, i in specs]


def _sums(df: DataFrame, models: list[Fitted], vec: str) -> pa.Table:
    """(model, cell, n, total, cost) over all rows; at most one row a centre."""
    sent = df.sparkSession.sparkContext.broadcast([m.centers for m in models])

    def listed(model: np.ndarray, cell: np.ndarray, n: np.ndarray, total: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(cell), pa.array(n), lists, pa.array(cost)], names=["model", "cell", "n", "total", "cost"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        total = [np.zeros_like(c) for c in centers]
        n, cost = [np.zeros(len(c), dtype=np.int64) for c in centers], [np.zeros(len(c)) for c in centers]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _rows(batch.column(0).to_pandas())
            for m, c in enumerate(centers):
                cell, dist = nearest(x, c)
                order = np.argsort(cell, kind="stable")
                used, first = np.unique(cell[order], return_index=True)
                total[m][used] += np.add.reduceat(x[order], first, axis=0)
                n[m] += np.bincount(cell, minlength=len(c))
                cost[m] += np.bincount(cell, weights=dist, minlength=len(c))
        for m in range(len(centers)):
            used = np.flatnonzero(n[m])
            if len(used):
                yield listed(np.full(len(used), m), used, n[m][used], total[m][used], cost[m][used])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        model, cell, n, cost = (rows[c].to_numpy() for c in ("model", "cell", "n", "cost"))
        order = np.lexsort((cell, model))
        first = np.flatnonzero(np.r_[True, (np.diff(model[order]) != 0) | (np.diff(cell[order]) != 0)])
        total = pc.list_flatten(rows["total"]).to_numpy().reshape(len(n), -1)[order]
        yield listed(model[order][first], cell[order][first], np.add.reduceat(n[order], first), np.add.reduceat(total, first, axis=0), np.add.reduceat(cost[order], first))

    schema = "model int, cell long, n long, total array<double>, cost double"
    part = df.select(vec).mapInArrow(add, schema).repartition(df.sparkSession.sparkContext.defaultParallelism, "model", "cell")
    out = part.mapInArrow(meet, schema).toArrow()
    sent.destroy()
    return out


def _passes(models: list[Fitted]) -> Iterator[list[Fitted]]:
    """The models in runs of at most ``CENTER_BYTES`` of centres, one at least."""
    run, size = [], 0
    for m in models:
        if run and size + m.centers.nbytes > CENTER_BYTES:
            yield run
            run, size = [], 0
        run, size = [*run, m], size + m.centers.nbytes
    if run:
        yield run


def fit(df: DataFrame, specs: list[tuple[int, int]], seed: int, max_iter: int = 100, tol: float = 1e-4, vec: str = "vec",
        id_col: str = "docid", spread: bool = False, on_done: Callable[[list[Fitted]], None] | None = None, best: bool = False) -> list[Fitted]:
    """One model for each (k, start) of ``specs``, or with ``best`` the cheapest of each K; ``on_done`` is called with the models that an iteration finished.

    With ``best`` and spread starts, rows of at most ``HELD_BYTES`` that are all in the pool go to all workers and are fitted model by model.
    """
    if not specs:
        return []
    if best:
        n, room = df.count(), POOL * max(k for k, _ in specs) * (1 + max(i for _, i in specs))
        if spread and on_done is None and 0 < n <= room and n * max(1, df.select(F.size(vec)).first()[0]) * 8 <= HELD_BYTES:
            return _held_fit(df, specs, _pool(df, room, seed, vec, id_col), seed, max_iter, tol)
        return _cheapest(fit(df, specs, seed, max_iter, tol, vec, id_col, spread, on_done))
    models = starts(df, specs, seed, vec, id_col, spread)
    active = models
    for i in range(max_iter):
        moved = []
        for run in _passes(active):
            rows = _sums(df, run, vec).combine_chunks()
            model, cell, n, cost = (rows[c].to_numpy() for c in ("model", "cell", "n", "cost"))
            total = pc.list_flatten(rows["total"]).to_numpy().reshape(len(n), run[0].centers.shape[1])
            for j, m in enumerate(run):
                own = model == j
                new = m.centers.copy()
                new[cell[own]] = total[own] / n[own][:, None]
                moved.append(np.sqrt(((new - m.centers) ** 2).sum(axis=1)).max())
                m.centers, m.cost, m.iterations = new, float(cost[own].sum()), i + 1
        finished = [m for m, d in zip(active, moved) if d <= tol or i + 1 == max_iter]
        active = [m for m in active if not any(m is f for f in finished)]
        if finished and on_done:
            on_done(finished)
        if not active:
            break
    return models


def cell_of(df: DataFrame, model: Fitted, vec: str = "vec") -> Column:
    """The nearest centre's number."""
    sent = df.sparkSession.sparkContext.broadcast(model.centers)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(_rows(v), sent.value)[0].astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    return cell(vec)


def cosine_sse(df: DataFrame, models: list[Fitted], vec: str = "vec") -> list[float]:
    """Σ (1 - cos(row, its nearest centre))² of each model, all in one pass; a zero vector's cosine is 0."""
    sent = df.sparkSession.sparkContext.broadcast([m.centers for m in models])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(len(sent.value))
        for batch in batches:
            if batch.empty:
                continue
            x = _rows(batch[vec])
            norm = np.linalg.norm(x, axis=1)
            for m, c in enumerate(sent.value):
                own = c[nearest(x, c)[0]]
                both = norm * np.linalg.norm(own, axis=1)
                out[m] += ((1.0 - (x * own).sum(axis=1) / np.where(both > 0, both, 1.0)) ** 2).sum()
        yield pd.DataFrame({"model": np.arange(len(out)), "sse": out})

    rows = df.select(vec).mapInPandas(add, "model int, sse double").groupBy("model").agg(F.sum("sse").alias("sse")).collect()
    by_model = {r["model"]: r["sse"] for r in rows}
    return [float(by_model.get(m, 0.0)) for m in range(len(models))]
