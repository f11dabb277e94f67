"""Exact blocked similarity joins (J7, J8, J9, J10, J11, J12, J14, W4, A17 support).

A dense similarity join is all-pairs by nature.  When one side is small (its vectors' bytes are checked), it is sent to all
workers and the other side is scanned in place: a corpus is then neither shuffled nor replicated.  Otherwise the rows of
each side are packed into blocks of at most ``block_rows`` (one row a block) and written; every task reads a part of the left
blocks and a part of the right ones from there, so no row is shuffled once for each block it meets and what is
written grows with the rows, not with the pairs.  One vectorised NumPy product per block pair produces only what the
caller needs: a per-row top-k with a tie margin, a count above a threshold, edges above a threshold, a masked maximum, or the
best match inside allowed groups.  The results of a left block are merged over all right blocks of the task, so a left row
leaves a task with one result.  Nothing is collected to the driver but a small side; a task holds its part of the right
blocks and ``block_rows`` x ``block_rows`` doubles.

Counts and edges over a threshold compare only groups of vectors that pivot bounds (``pivots.py``) let meet.

Top-k scores are rounded to 6 decimals and cut by (score, id) inside the kernel, then merged by a
two-phase top-k in Spark; rank counts compare scores rounded to 6 decimals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irforge.operators import pivots as pv
from irforge.operators import topk as tk
from irforge.operators.common import topk_per_group
from irforge.session import materialize

BLOCK_ROWS = 2048
MIN_BLOCKS = 4          # at least 4 blocks a side, so small inputs still use several tasks
TIE_MARGIN = 1e-6
# Left rows of one product when products over a threshold are counted.
COUNT_ROWS = 512
# Columns that rule out pairs.
MASKS = {"lorder", "lexcl", "lgroups"}
# A side whose vectors take no more than this (rows counted, times dimension) is sent to all workers.
BROADCAST_BYTES = 32 << 20
# A file of packed blocks holds about so many bytes of vectors, and a task's right blocks of a top-k.
PART_BYTES = 64 << 20
# A shuffled result of a top-k (left and right id, score) is taken as so many bytes.
RESULT_BYTES = 24
# Results of a left block are merged when so many rows have come together.
MERGE_ROWS = 1 << 18


def _mat(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _scores(L: np.ndarray, R: np.ndarray, metric: str) -> np.ndarray:
    S = L @ R.T
    if metric == "l2":
        S = np.sqrt(np.maximum((L * L).sum(1)[:, None] + (R * R).sum(1)[None, :] - 2.0 * S, 0.0))
    return S


def _exact(L, R, i, j, metric):
    if metric == "l2":
        return np.sqrt(((L[i] - R[j]) ** 2).sum(1))
    return (L[i] * R[j]).sum(1)


def _counted(L: np.ndarray, R: np.ndarray, lid: np.ndarray, rid: np.ndarray, threshold: float, exclude_self: bool) -> np.ndarray:
    """How many inner products of each left row are above a positive threshold.

    Products are done in single precision if no value is too large for it; those within the bound of its error are done again in double."""
    norm, reach = np.linalg.norm(L, axis=1), np.linalg.norm(R, axis=1).max()
    single = bool(max(norm.max(), reach, norm.max() * reach) < 1e30)  # not so if any is NaN
    l, r = (L.astype(np.float32), R.astype(np.float32).T) if single else (L, R.T)  # noqa: E741
    slack = norm * reach * (L.shape[1] + 8) * 2.0 ** -24 if single else np.zeros(len(L))
    out = np.zeros(len(L), dtype=np.int64)
    for at in range(0, len(L), COUNT_ROWS):
        s, more = l[at:at + COUNT_ROWS] @ r, slack[at:at + COUNT_ROWS]
        floor = np.nextafter((threshold - more).astype(s.dtype), s.dtype.type(-np.inf))
        hit = np.flatnonzero(s >= floor[:, None])
        i, j = np.divmod(hit, s.shape[1])
        above = s.ravel()[hit] > threshold + more[i] + 1e-6 * threshold
        unsure = np.flatnonzero(~above)
        above[unsure] = _exact(L, R, at + i[unsure], j[unsure], "ip") > threshold
        if exclude_self:
            above &= lid[at + i] != rid[j]
        out[at:at + COUNT_ROWS] = np.bincount(i[above], minlength=len(s))
    return out


_PD_TYPES = {"string": "object", "double": "float64", "bigint": "int64", "int": "int32", "long": "int64"}


def empty_frame(schema: str) -> pd.DataFrame:
    """A typed empty result (an untyped empty frame fails Arrow conversion)."""
    cols = [c.strip().split() for c in schema.split(",")]
    return pd.DataFrame({n: pd.Series([], dtype=_PD_TYPES[t]) for n, t in cols})


def _kernel(mode: str, metric: str, k: int, threshold: float, exclude_self: bool, out_cols: list[str], schema: str = ""):
    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return empty_frame(schema)
        L, R = _mat(lp["lvec"]), _mat(rp["rvec"])
        lid = lp["lid"].to_numpy()
        rid = rp["rid"].to_numpy()
        if mode == "count" and metric == "ip" and threshold > 0 and not MASKS & {*lp.columns, *rp.columns}:
            return pd.DataFrame({"lid": lid, "cnt": _counted(L, R, lid, rid, threshold, exclude_self)})
        S = _scores(L, R, metric)
        bad = np.zeros(S.shape, dtype=bool)
        if exclude_self:
            codes = pd.factorize(np.concatenate([lid, rid]))[0]
            own, other = codes[:len(lid)], codes[len(lid):]
            if np.isin(own, other).any():
                bad |= own[:, None] == other[None, :]
        if "lorder" in lp.columns:  # right rows must come strictly before the left row
            bad |= ~(rp["rorder"].to_numpy()[None, :] < lp["lorder"].to_numpy()[:, None])
        if "lexcl" in lp.columns:   # one excluded right id per left row
            bad |= lp["lexcl"].to_numpy()[:, None] == rid[None, :]
        if "lgroups" in lp.columns:  # allowed right groups per left row
            rg = rp["rgroup"].to_numpy()
            G = np.vstack([np.asarray(g, dtype=np.int64) for g in lp["lgroups"].to_numpy()])
            bad |= ~(rg[None, :, None] == G[:, None, :]).any(2)
        if mode == "topk":
            sign = -1.0 if metric != "l2" else 1.0
            V = np.where(bad, np.inf, sign * S)
            kth = np.partition(V, min(k, V.shape[1]) - 1, axis=1)[:, min(k, V.shape[1]) - 1]
            i, j = np.nonzero((V <= (kth + TIE_MARGIN)[:, None]) & ~bad)
            score = np.round(_exact(L, R, i, j, metric), 6)
            # ties are cut here by id, so at most k rows of each left row leave the kernel
            place = np.empty(len(rid), dtype=np.int64)
            place[np.argsort(rid, kind="stable")] = np.arange(len(rid))
            order = np.lexsort((place[j], sign * score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            return pd.DataFrame({"lid": lid[i[first]], "rid": rid[j[first]], "score": score[first]})
        if mode in ("edges", "edges_ge"):
            hit = (S >= threshold) if mode == "edges_ge" else (S > threshold)
            i, j = np.nonzero(hit & ~bad)
            return pd.DataFrame({"lid": lid[i], "rid": rid[j], "score": S[i, j]})
        if mode == "count":
            cnt = np.count_nonzero((S > threshold) & ~bad, axis=1)
            return pd.DataFrame({"lid": lid, "cnt": cnt.astype(np.int64)})
        if mode == "rank":  # how many right rows beat the left row's own score (ties by smaller id)
            # own scores come from another routine: equal vectors are equal only after rounding
            own = np.round(lp["lthr"].to_numpy().astype(np.float64), 6)[:, None]
            pos = lp["lexcl"].to_numpy()[:, None]
            S = np.round(S, 6)
            better = (S > own) | ((S == own) & (rid[None, :] < pos))
            cnt = (better & ~bad).sum(1)
            return pd.DataFrame({"lid": lid, "cnt": cnt.astype(np.int64)})
        if mode == "max":
            V = np.where(bad, -np.inf, S)
            ok = (~bad).any(1)
            return pd.DataFrame({"lid": lid[ok], "score": V[ok].max(1)})
        if mode == "group_sum":  # per (left row, right group): sum and count of allowed scores
            rg = rp["rgroup"].to_numpy()
            rows = []
            for g in np.unique(rg):
                cols = rg == g
                ok = ~bad[:, cols]
                rows.append(pd.DataFrame({"lid": lid, "rgroup": g, "s": np.where(ok, S[:, cols], 0.0).sum(1),
                                          "n": ok.sum(1).astype(np.int64)}))
            return pd.concat(rows)
        if mode == "group_best":
            rg = rp["rgroup"].to_numpy()
            rows = []
            for g in np.unique(rg):
                cols = rg == g
                V = np.where(bad[:, cols], -np.inf, S[:, cols])
                ok = np.isfinite(V).any(1)
                if not ok.any():
                    continue
                jj = np.nonzero(cols)[0][V.argmax(1)]
                rows.append(pd.DataFrame({"lid": lid[ok], "rgroup": g, "rid": rid[jj[ok]], "score": V.max(1)[ok]}))
            return pd.concat(rows) if rows else empty_frame(schema)
        raise ValueError(mode)
    return fn


_SCHEMAS = {
    "topk": "lid string, rid string, score double",
    "edges": "lid string, rid string, score double",
    "edges_ge": "lid string, rid string, score double",
    "count": "lid string, cnt bigint",
    "rank": "lid string, cnt bigint",
    "max": "lid string, score double",
    "group_best": "lid string, rgroup int, rid string, score double",
    "group_sum": "lid string, rgroup int, s double, n bigint",
}


def _scan(small: DataFrame, large: DataFrame, fn, schema: str) -> DataFrame:
    """Kernel results of every chunk of ``large`` against the whole of ``small``; only ``small`` moves."""
    sent = small.sparkSession.sparkContext.broadcast(small.toPandas())

    def scan(batches):
        own = sent.value
        for batch in batches:
            for i in range(0, len(batch), BLOCK_ROWS):
                for j in range(0, len(own), BLOCK_ROWS):
                    yield fn(own.iloc[j:j + BLOCK_ROWS], batch.iloc[i:i + BLOCK_ROWS])

    return large.mapInPandas(scan, schema)


def _merged(frames: list[pd.DataFrame], mode: str, k: int, metric: str) -> pd.DataFrame:
    """One result for a left row (and group) from those of several right blocks."""
    rows = pd.concat(frames, ignore_index=True)
    if mode in ("count", "rank"):
        return rows.groupby("lid", as_index=False, sort=False, dropna=False)["cnt"].sum()
    if mode == "max":
        return rows.groupby("lid", as_index=False, sort=False, dropna=False)["score"].max()
    if mode == "group_sum":
        return rows.groupby(["lid", "rgroup"], as_index=False, sort=False, dropna=False)[["s", "n"]].sum()
    if mode == "group_best":
        return rows.sort_values(["score", "rid"]).drop_duplicates(["lid", "rgroup"], keep="last")
    rows = rows.sort_values(["score", "rid"], ascending=[metric == "l2", True])
    return rows.groupby("lid", sort=False, dropna=False).head(k)


def _packed(df: DataFrame, n: int, dim: int, block_rows: int, min_blocks: int, order: list[str]) -> DataFrame:
    """(block, data): at most ``block_rows`` rows of ``df`` in a row, as an Arrow stream, written once; its first two columns are id and vector.

    Rows are in ``order`` over all files, if it is given; rows that tie there are dealt out by a hash of the id.
    """
    block_rows = max(1, min(block_rows, -(-n // min_blocks)))
    files = max(1, -(-n * max(1, dim) * 8 // PART_BYTES), min(-(-n // block_rows), 4 * df.sparkSession.sparkContext.defaultParallelism))
    if order:
        rows = df.repartitionByRange(files, *order, F.xxhash64(df.columns[0])).sortWithinPartitions(*order)
    else:
        rows = df.repartition(files)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part, sink = batch.slice(at, block_rows), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    return materialize(rows.mapInArrow(pack, "data binary").select(F.monotonically_increasing_id().alias("block"), "data"))


def _unpacked(data: bytes, side: str) -> pd.DataFrame:
    """The rows of a block, with the id and vector columns of the side (l or r)."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    vectors = table.column(1).combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    dim = len(values) // max(1, table.num_rows)
    if vectors.null_count or (vectors.value_lengths().to_numpy() != dim).any():
        raise ValueError("vectors of one length are needed")
    rows = table.remove_column(1).to_pandas()
    rows.columns = [f"{side}id", *rows.columns[1:]]
    rows[f"{side}vec"] = list(values.reshape(table.num_rows, dim))
    return rows


def _paired(left: DataFrame, right: DataFrame, compare: Callable[[object, object], Iterator[pd.DataFrame]], merge: Callable[[list[pd.DataFrame]], pd.DataFrame] | None,
            schema: str, load: Callable[[bytes, str], object] = _unpacked) -> DataFrame:
    """Results of ``compare`` for every pair of packed blocks, merged for each left block in a task if ``merge`` is given.

    The hint asks for the join without a shuffle: a task reads its part of either table and takes the left blocks one by one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, found = None, None, []
        for batch in batches:
            for block, mine, other in zip(batch["lb"], batch["ldata"], batch["rdata"]):
                if block != at:
                    if found:
                        yield merge(found)
                    at, own, found = block, load(mine, "l"), []
                for out in compare(own, load(other, "r")):
                    if merge is None:
                        yield out
                        continue
                    found.append(out)
                    if sum(map(len, found)) > MERGE_ROWS:
                        found = [merge(found)]
        if found:
            yield merge(found)

    pairs = left.toDF("lb", "ldata").hint("shuffle_replicate_nl").crossJoin(right.select(F.col("data").alias("rdata")))
    return pairs.mapInPandas(run, schema)


#: Modes whose results are pairs over a threshold.
PIVOTED = ("count", "edges", "edges_ge")
#: Two sets of vectors are compared group by group if this part of their pairs, or less, is left by the bounds.
SPARSE = 0.5


@dataclass
class Grouped:
    """Rows with the ranges of their groups and each row's place among these."""
    rows: pd.DataFrame
    place: np.ndarray
    ranges: pd.DataFrame

    @classmethod
    def of(cls, rows: pd.DataFrame, g: np.ndarray, angle: np.ndarray, norm: np.ndarray) -> Grouped:
        ranges = pv.ranges_of(g, angle, norm)
        return cls(rows, np.searchsorted(ranges["g"].to_numpy(), g), ranges)


def _meeting(pivots: pv.Pivots, a: Grouped, b: Grouped, threshold: float, sparse: float) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Parts of a and of b that may meet."""
    meets = pivots.may_meet(a.ranges, b.ranges, threshold)
    if np.bincount(a.place) @ meets @ np.bincount(b.place) > sparse * len(a.rows) * len(b.rows):
        yield a.rows, b.rows  # too little to skip to be worth many small products
        return
    # groups that meet the same others are compared at once
    same, label = np.unique(meets, axis=0, return_inverse=True)
    label = label.reshape(-1)[a.place]
    for c in np.flatnonzero(same.any(axis=1)):
        yield a.rows[label == c], b.rows[same[c][b.place]]


def _pivoted(left: DataFrame, right: DataFrame, nl: int, nr: int, dim: int, fn, schema: str, threshold: float, block_rows: int, min_blocks: int,
             merge: Callable[[list[pd.DataFrame]], pd.DataFrame] | None) -> DataFrame:
    """Kernel results of the groups that may meet."""
    spark, sparse = left.sparkSession, SPARSE
    small, small_id, small_vec = (left, "lid", "lvec") if nl <= nr else (right, "rid", "rvec")
    # pivots change the work only, so those of a collected side come from its rows as they are
    if min(nl, nr) * max(1, dim) * 8 <= BROADCAST_BYTES:
        own = small.toPandas()
        x = _mat(own[small_vec])
        pivots = pv.from_rows(x[np.random.default_rng(pv.SEED).permutation(len(x))[:min(math.isqrt(len(x)), pv.MAX_PIVOTS)]])
        g, angle, norm = pivots.place(x)
        order = np.argsort(g, kind="stable")
        own = own.iloc[order].reset_index(drop=True)
        sent = spark.sparkContext.broadcast((pivots, Grouped.of(own, g[order], angle[order], norm[order])))
        large_vec = "rvec" if nl <= nr else "lvec"

        def scan(batches):
            p, whole = sent.value
            for batch in batches:
                if batch.empty:
                    continue
                for mine, near in _meeting(p, Grouped.of(batch, *p.place(_mat(batch[large_vec]))), whole, threshold, sparse):
                    for i in range(0, len(mine), block_rows):
                        for j in range(0, len(near), block_rows):
                            a, b = near.iloc[j:j + block_rows], mine.iloc[i:i + block_rows]
                            yield fn(a, b) if nl <= nr else fn(b, a)

        return (right if nl <= nr else left).mapInPandas(scan, schema)
    pivots = pv.choose(small, min(nl, nr) // block_rows, small_id, small_vec)
    sent = spark.sparkContext.broadcast(pivots)
    # in the order of groups, so that a block holds few of them
    packed = lambda df, n, vec: _packed(materialize(pv.placed(df, pivots, vec)), n, dim, block_rows, min_blocks, ["_g"])
    blocks = packed(left, nl, "lvec")
    others = blocks if left is right else packed(right, nr, "rvec")

    def load(data: bytes, side: str) -> Grouped:
        rows = _unpacked(data, side)
        return Grouped.of(rows.drop(columns=["_g", "_angle", "_norm"]), *[rows[c].to_numpy() for c in ("_g", "_angle", "_norm")])

    def compare(a: Grouped, b: Grouped) -> Iterator[pd.DataFrame]:
        return (fn(x, y) for x, y in _meeting(sent.value, a, b, threshold, sparse))

    return _paired(blocks, others, compare, merge, schema, load)


def block_join(left: DataFrame, right: DataFrame, mode: str, *, left_id: str = "docid", right_id: str = "docid",
               left_vec: str = "vec", right_vec: str = "vec", metric: str = "ip", k: int = 10,
               threshold: float = 0.0, exclude_self: bool = False, left_cols: dict[str, str] | None = None,
               right_cols: dict[str, str] | None = None, block_rows: int = BLOCK_ROWS,
               min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """Raw per-block results; see the module docstring.  ``left_cols``/``right_cols`` map kernel
    inputs (lorder, lexcl, lthr, lgroups / rorder, rgroup) to column names."""
    left_cols, right_cols = left_cols or {}, right_cols or {}
    nl = left.count()
    nr = nl if left is right else right.count()
    L = left.select(F.col(left_id).cast("string").alias("lid"), F.col(left_vec).cast("array<double>").alias("lvec"),
                    *[F.col(c).alias(a) for a, c in left_cols.items()])
    R = right.select(F.col(right_id).cast("string").alias("rid"), F.col(right_vec).cast("array<double>").alias("rvec"),
                     *[F.col(c).alias(a) for a, c in right_cols.items()])
    if left is right and (left_id, left_vec) == (right_id, right_vec) and not left_cols and not right_cols:
        R = L  # packed once
    schema = _SCHEMAS[mode]
    fn = _kernel(mode, metric, k, threshold, exclude_self, [], schema)
    if min(nl, nr) == 0:
        return left.sparkSession.createDataFrame([], schema)
    dim = (left if nl <= nr else right).select(F.size(left_vec if nl <= nr else right_vec)).first()[0]
    small = min(nl, nr) * max(1, dim) * 8 <= BROADCAST_BYTES
    if small and R is L:
        R = L.toDF("rid", "rvec")
    merge = None if mode in ("edges", "edges_ge") else lambda frames: _merged(frames, mode, k, metric)
    if mode in PIVOTED and metric == "ip":
        return _pivoted(L, R, nl, nr, dim, fn, schema, threshold, block_rows, min_blocks, merge)
    if small:
        return _scan(L, R, fn, schema) if nl <= nr else _scan(R, L, lambda r, l: fn(l, r), schema)
    blocks = _packed(L, nl, dim, block_rows, min_blocks, [])
    others = blocks if R is L else _packed(R, nr, dim, block_rows, min_blocks, ["rgroup"] if "rgroup" in right_cols else [])
    if mode == "topk":  # k rows of each left row leave a task, so few tasks share a left row
        others = others.coalesce(max(1, -(-nr * max(1, dim) * 8 // PART_BYTES)))
    return _paired(blocks, others, lambda a, b: [fn(a, b)], merge, schema)


def _distances(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Distance sums of the rows of ``a`` to the clusters of ``b``, whose rows are in the order of clusters.

    Only the first and the last cluster of ``b`` may go on in another block; of the others a row needs its own
    cluster's sum and the least mean.
    """
    S = _scores(_mat(a["lvec"]), _mat(b["rvec"]), "l2")
    ids = pd.factorize(np.concatenate([a["lid"].to_numpy(), b["rid"].to_numpy()]))[0]
    groups, first = np.unique(b["cid"].to_numpy(), return_index=True)
    n = np.broadcast_to(np.diff([*first, len(b)]), (len(a), len(groups)))
    if np.isin(ids[:len(a)], ids[len(a):]).any():
        same = ids[:len(a), None] == ids[None, len(a):]
        S[same] = 0.0
        n = n - np.add.reduceat(same.astype(np.int64), first, axis=1)
    s, own = np.add.reduceat(S, first, axis=1), a["cid"].to_numpy()
    at = np.minimum(np.searchsorted(groups, own), len(groups) - 1)
    row, inside = np.arange(len(a)), (groups[at] == own) & (at > 0) & (at < len(groups) - 1)
    mean = np.where(n > 0, s / np.maximum(n, 1), np.inf)
    mean[row[inside], at[inside]] = np.inf
    yield pd.DataFrame({"lid": a["lid"].to_numpy(), "lcid": own, "rgroup": own, "s": np.where(inside, s[row, at], 0.0), "n": np.where(inside, n[row, at], 0),
                        "least": mean[:, 1:-1].min(axis=1, initial=np.inf)})
    for g in {0, len(groups) - 1}:
        yield pd.DataFrame({"lid": a["lid"].to_numpy(), "lcid": own, "rgroup": groups[g], "s": s[:, g], "n": n[:, g], "least": np.inf})


def _merged_distances(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True).groupby(["lid", "lcid", "rgroup"], as_index=False, sort=False, dropna=False).agg({"s": "sum", "n": "sum", "least": "min"})


def cluster_distances(df: DataFrame, *, id_col: str = "docid", vec: str = "vec", cid: str = "cid", block_rows: int = BLOCK_ROWS,
                      min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """(lid, lcid, a, b): a row's mean Euclidean distance to the other rows of its cluster and the least one to another cluster.

    Rows are compared in the order of clusters, so means are done block by block and no row of (document, cluster) is made
    for clusters that lie within a block.
    """
    rows = df.where(F.col(cid).isNotNull()).select(F.col(id_col).cast("string").alias("lid"), F.col(vec).cast("array<double>").alias("lvec"), F.col(cid).cast("int").alias("cid"))
    n = rows.count()
    schema = "lid string, lcid int, rgroup int, s double, n bigint, least double"
    dim = max(1, rows.select(F.size("lvec")).first()[0]) if n else 1
    if n * dim * 8 <= BROADCAST_BYTES:
        sent = df.sparkSession.sparkContext.broadcast(rows.toDF("rid", "rvec", "cid").toPandas().sort_values("cid", kind="stable", ignore_index=True))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = sent.value
            for batch in batches:
                for i in range(0, len(batch), block_rows):
                    mine = batch.iloc[i:i + block_rows]
                    yield _merged_distances([out for j in range(0, len(own), block_rows) for out in _distances(mine, own.iloc[j:j + block_rows])])

        raw = rows.mapInPandas(scan, schema)
    else:
        blocks = _packed(rows, n, dim, block_rows, min_blocks, ["cid"])
        raw = _paired(blocks, blocks, _distances, _merged_distances, schema)
    per = raw.groupBy("lid", "lcid", "rgroup").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("least").alias("least"))
    mean, own = F.when(F.col("n") > 0, F.col("s") / F.col("n")), F.col("rgroup") == F.col("lcid")
    ab = per.groupBy("lid", "lcid").agg(F.max(F.when(own, mean)).alias("a"), F.least(F.min(F.when(~own, mean)), F.min("least")).alias("b"))
    return ab.withColumn("b", F.when(F.col("b") < float("inf"), F.col("b"))).where("lid IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)")


def topk(left: DataFrame, right: DataFrame, k: int, metric: str = "ip", **kw) -> DataFrame:
    """Exact top-k per left row: (lid, rid, score rounded to 6, rank), ties by rid ascending.

    Inner products of many left rows go block by block of these (``topk.py``): their k best are final when they leave a task.  Few left rows are sent out and
    the right ones scanned in place."""
    if metric == "ip" and kw.keys() <= {"left_id", "right_id", "left_vec", "right_vec", "block_rows", "min_blocks"}:
        L = left.select(F.col(kw.get("left_id", "docid")).cast("string").alias("lid"), F.col(kw.get("left_vec", "vec")).cast("array<double>").alias("lvec"))
        R = right.select(F.col(kw.get("right_id", "docid")).cast("string").alias("rid"), F.col(kw.get("right_vec", "vec")).cast("array<double>").alias("rvec"))
        nl, nr = left.count(), right.count()
        if min(nl, nr) == 0:
            return left.sparkSession.createDataFrame([], tk.SCHEMA)
        dim = max(1, R.select(F.size("rvec")).first()[0])
        scanned = nl * k * RESULT_BYTES * max(left.sparkSession.sparkContext.defaultParallelism, nr * dim * 8 >> 27)
        if scanned > nr * dim * 8 or nl * dim * 8 > BROADCAST_BYTES:
            return tk.topk(L, R, k, nl, nr, dim, BROADCAST_BYTES)
    raw = block_join(left, right, "topk", metric=metric, k=k, **kw)
    order = F.desc("score") if metric != "l2" else F.asc("score")
    return topk_per_group(raw, ["lid"], [order, F.asc("rid")], k, split_col="rid")


def threshold_count(left: DataFrame, right: DataFrame, threshold: float, **kw) -> DataFrame:
    """(lid, cnt): right rows with score > threshold, summed over blocks."""
    raw = block_join(left, right, "count", threshold=threshold, **kw)
    return raw.groupBy("lid").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def threshold_edges(left: DataFrame, right: DataFrame, threshold: float, **kw) -> DataFrame:
    return block_join(left, right, "edges", threshold=threshold, **kw)


def masked_max(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    raw = block_join(left, right, "max", **kw)
    return raw.groupBy("lid").agg(F.max("score").alias("score"))


def rank_counts(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    raw = block_join(left, right, "rank", **kw)
    return raw.groupBy("lid").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def group_best(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    """Best right row per (left row, allowed group): (lid, rgroup, rid, score)."""
    raw = block_join(left, right, "group_best", **kw)
    return (raw.groupBy("lid", "rgroup")
               .agg(F.max_by(F.struct("score", "rid"), F.struct("score", F.col("rid"))).alias("b"))
               .select("lid", "rgroup", "b.rid", "b.score"))
