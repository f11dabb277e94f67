import hashlib

import numpy as np
import pytest

from irforge.llm import centroid_clustering as cc
from oracle_check import compare, duck

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters, rounds, dims, scale, seed):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), k in zip(kept, own) if k == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def float32(x):
    return [None if y is None else float(np.float32(y)) for y in x]


def small_rows(dims=4, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, float32(rng.normal(0, 0.3, dims).tolist())) for i in range(n)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # copies
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (None, None), (900, None), (901, []), (902, rows[1][1] + [0.0]),
             (903, [None] + rows[1][1][1:]), (904, [float("nan")] + rows[1][1][1:]), (905, [float("-inf")] + rows[1][1][1:]), (906, [0.0] * dims), (907, [-0.0] * dims)]
    return rows


@pytest.mark.parametrize("clusters,scale", [(8, 1024), (3, 2), (300, 8)])
def test_equals_brute_force(spark, clusters, scale):
    rows = small_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5).selectExpr("*", "1 AS v", "2 AS cluster", "'x' AS distance", "3 AS n")
    got, centroids = cc.cluster(df, clusters=clusters, rounds=4, dims=4, scale=scale)
    want, expected = brute(rows, clusters, 4, 4, scale, cc.SEED)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert centroids.tolist() == expected


@pytest.mark.parametrize("k,dims,span", [(1, 3, 2), (2, 2, 2), (9, 2, 3), (200, 3, 5), (400, 8, 40)])
def test_tree_finds_the_lowest_of_the_nearest(k, dims, span):
    rng = np.random.default_rng(k)
    centroids, x = rng.integers(-span, span + 1, (k, dims)), rng.integers(-span, span + 1, (700, dims))
    who, best, _ = cc.VantageTree(centroids).nearest(x)
    d = ((x[:, None] - centroids[None]) ** 2).sum(-1)
    assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_tree_skips_centroids():
    rng = np.random.default_rng(1)
    groups = rng.integers(-10_000, 10_000, (40, 6))
    centroids = (groups[:, None] + rng.integers(-30, 30, (40, 10, 6))).reshape(-1, 6)
    x = groups[rng.integers(0, 40, 500)] + rng.integers(-30, 30, (500, 6))
    who, _, seen = cc.VantageTree(centroids).nearest(x)
    assert seen < 0.25 * len(x) * len(centroids) and (who == ((x[:, None] - centroids[None]) ** 2).sum(-1).argmin(axis=1)).all()


def test_large_components():
    top = 1 << 27
    centroids, x = np.array([[top, top], [top - 1, top], [-top, -top]]), np.array([[top, top], [top - 1, top - 1], [-top, top]])
    who, best, _ = cc.VantageTree(centroids).nearest(x)
    assert who.tolist() == [0, 1, 1] and best.tolist() == [0, 1, (2 * top - 1) ** 2]


def test_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        cc.cluster(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA), dims=2)


def test_empty_table(spark):
    rows, centroids = cc.cluster(spark.createDataFrame([], SCHEMA))
    assert rows.count() == 0 and rows.columns == ["vec_id", "cluster", "distance"] and not len(centroids)


def test_query_and_its_twin_on_edge_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = small_rows(64, 80) + [(1000 + i, float32(rng.normal(5, 0.1, 64).tolist())) for i in range(20)]
    spark.createDataFrame([(i, v, 1) for i, v in rows if i is not None], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duck(str(tmp_path / "other"))
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    line, ok = compare(spark, "op11", cc.op11_centroid_clustering, cc.SQL, str(tmp_path), con)
    assert ok, line
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert cc.op11_centroid_clustering(spark, str(tmp_path / "none")).count() == 0
