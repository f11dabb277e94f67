"""Centroid clustering: Lloyd rounds in exact integers, with a vantage-point tree over the centroids.

Every round builds a tree over the centroids, which are few and known to the driver, and broadcasts it.
A task searches the tree for each of its vectors: best node first, by a lower bound on the distance to
anything below it, until no open node can hold a centroid that is as near as the best one found.  The
pruning radius is inclusive, so an equally near centroid of a smaller number is still found.  Bounds are
floating-point and rounded down; distances that decide are exact integers.  The searches of a
block of vectors advance together, each along its own order of nodes.

A task hands on one row of sums for each centroid, so neither a hot cluster nor the number of vectors
reaches the driver: it gets clusters x (dims + 1) numbers a round.

Defined cases: null vectors, vectors of another length and vectors with null or non-finite components are
left out; a null vec_id is clustered but starts a centroid only after all other ids; repeated rows are vectors
each, and those of one id start centroids in ascending order of their components; fewer vectors
than clusters give as many centroids as vectors; an empty table gives an empty result; a component whose
integer is so large that squared distances don't fit a long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.integer_vectors import complete, integers, matrix, summed
from irforge.session import materialize

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
#: Most centroids of a leaf.
LEAF = 2
#: Entries of the table of bounds that a block of vectors may take.
BOUNDS = 1 << 20
#: Relative width by which bounds are lowered, far above the rounding error of a double's square root.
SLACK = 1e-12


@dataclass
class Node:
    #: Centroids that are compared at this node: the vantage point, or a leaf's members.
    members: list[int]
    #: (node, least and largest distance of its centroids from the vantage point)
    children: list[tuple[int, float, float]]


class VantageTree:
    """Exact nearest centroids; equally near ones go to the smaller number."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        self.nodes: list[Node] = []
        self._build(np.arange(len(centroids)), leaf)

    def _build(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        if len(members) <= leaf:
            self.nodes.append(Node(members.tolist(), []))
            return at
        node = Node([], [])
        self.nodes.append(node)
        # the vantage point is the member farthest from the first: the others spread most as seen from an edge
        spread = self._squared(self.centroids[members], members[0])
        vantage = members[int(spread.argmax())]
        rest = members[members != vantage]
        far = self._squared(self.centroids[rest], vantage)
        order = np.argsort(far, kind="stable")
        node.members = [int(vantage)]
        for part in np.array_split(order, 2):
            if len(part):
                radius = np.sqrt(far[part].astype(np.float64))
                node.children.append((self._build(rest[part], leaf), float(radius.min()), float(radius.max())))
        return at

    def _squared(self, x: np.ndarray, centroid: int) -> np.ndarray:
        gap = x - self.centroids[centroid]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many distances were computed."""
        out, block, seen = [], max(64, BOUNDS // len(self.nodes)), 0
        for i in range(0, len(x), block):
            who, best, n = self._search(x[i:i + block])
            out.append((who, best))
            seen += n
        return np.concatenate([o[0] for o in out] or [np.empty(0, np.int64)]), np.concatenate([o[1] for o in out] or [np.empty(0, np.int64)]), seen

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        best = np.full(len(x), np.iinfo(np.int64).max)
        who = np.full(len(x), len(self.centroids))
        bound = np.full((len(x), len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        live, seen = np.arange(len(x)), 0
        while len(live):
            open_bounds = bound[live]
            node = open_bounds.argmin(axis=1)
            low = open_bounds[np.arange(len(live)), node]
            inside = low <= np.sqrt(best[live].astype(np.float64)) * (1 + SLACK)
            live, node, low = live[inside], node[inside], low[inside]
            bound[live, node] = np.inf
            for j in np.unique(node).tolist():
                rows = live[node == j]
                for c in self.nodes[j].members:
                    d = self._squared(x[rows], c)
                    seen += len(rows)
                    nearer = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
                    best[rows[nearer]], who[rows[nearer]] = d[nearer], c
                if self.nodes[j].children:
                    away = np.sqrt(d.astype(np.float64))
                    for child, least, most in self.nodes[j].children:
                        gap = np.maximum(away - most, least - away) - SLACK * (away + most)
                        bound[rows, child] = np.maximum(gap, low[node == j])
        return who, best, seen


def kept_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): integer vectors, written once."""
    return materialize(vectors.where(complete("embedding") & (F.size("embedding") == dims)).select("vec_id", integers("embedding", scale, dims).alias("v")))


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in kept.orderBy(rank.asc_nulls_last(), "v").limit(clusters).select("v").collect()], dtype=np.int64)


def moved_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors that are nearest to each centroid; an unused one stays."""
    clusters, dims = centroids.shape
    tree = kept.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(clusters, dtype=np.int64), np.zeros((clusters, dims), dtype=np.int64)
        for b in batches:
            x = matrix(b.column(0), dims)
            who = tree.value.nearest(x)[0]
            order = np.argsort(who, kind="stable")
            used, at = np.unique(who[order], return_index=True)
            if len(used):
                s[used] += np.add.reduceat(x[order], at, axis=0)
                n += np.bincount(who, minlength=clusters)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    total = summed(kept.select("v").mapInArrow(sums, "cluster long, n long, s array<long>"), ["cluster"], dims).collect()
    tree.destroy()
    out = centroids.copy()
    for r in total:
        out[r.cluster] = [int(r[f"s{i}"]) // int(r.n) for i in range(dims)]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance), written."""
    dims = centroids.shape[1]
    tree = kept.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, best, _ = tree.value.nearest(matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = materialize(kept.mapInArrow(nearest, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"))
    tree.destroy()
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), final centroids) of vectors(vec_id, embedding)."""
    kept = kept_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return kept.selectExpr("vec_id", "cast(null AS int) AS cluster", "cast(null AS long) AS distance"), centroids
    for _ in range(rounds):
        centroids = moved_centroids(kept, centroids)
    return assigned(kept, centroids), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    # one row for each centroid: small by the operator's parameter
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), h) for i, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds one after the other; the key d * CLUSTERS + number orders by distance, then number."""
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT rid, i, v[i] AS x FROM kept, (SELECT unnest(range(1, {DIMS + 1})) AS i)),
c0 AS MATERIALIZED (
  SELECT c, i, v[i] AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS}),
  (SELECT unnest(range(1, {DIMS + 1})) AS i)),"""
    for r in range(ROUNDS + 1):
        text += f"""
a{r} AS MATERIALIZED (
  SELECT rid, min(key) % {CLUSTERS} AS c, min(key) // {CLUSTERS} AS d
  FROM (SELECT rid, sum((p.x - q.x) * (p.x - q.x)) * {CLUSTERS} + q.c AS key FROM part p JOIN c{r} q USING (i) GROUP BY rid, q.c) GROUP BY rid),"""
        if r < ROUNDS:
            text += f"""
c{r + 1} AS MATERIALIZED (
  SELECT q.c, q.i, coalesce(m.x, q.x) AS x FROM c{r} q LEFT JOIN
  (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM part JOIN a{r} USING (rid) GROUP BY c, i) m USING (c, i)),"""
    return text + f"""
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (rid) JOIN h USING (c)"""


SQL = _sql()
