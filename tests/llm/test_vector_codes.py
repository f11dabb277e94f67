import numpy as np
import pytest

from irforge.llm import vector_codes as vc
from oracle_check import compare, duck
from tests.llm.test_centroid_clustering import SCHEMA, float32, small_rows


def brute(rows, parts, entries, rounds, scale):
    """Every part against every entry in every round."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v in order] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((gap(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(cut(v, p), books[p])[1] for _, v in kept]
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v), k in zip(kept, own) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v in kept]
    return [(i, bytes(j for _, j in f), [d for d, _ in f]) for (i, _), f in zip(kept, found)], books


@pytest.mark.parametrize("entries,rounds,scale", [(64, 2, 256), (5, 6, 4), (256, 3, 16)])
def test_equals_brute_force(spark, entries, rounds, scale):
    rows = small_rows(8, 100)
    whole = [(i, v) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5).selectExpr("*", "1 AS v", "2 AS code", "'x' AS distance", "3 AS n", "4 AS row_id")
    got, books = vc.compress(df, parts=4, entries=entries, rounds=rounds, scale=scale)
    want, expected = brute(whole, 4, entries, rounds, scale)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.vec_id, bytes(r.code), r.distance) for r in got.collect()], key=key) == sorted(want, key=key)
    assert books.tolist() == expected


def test_recode_equals_a_full_scan_and_compares_less():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-6, 7, (3000, 2)), rng.integers(-6, 7, (40, 2))
    code, distance = vc.nearest(x, book)
    for _ in range(20):
        new, moved = book.copy(), np.zeros(len(book), dtype=bool)
        some = rng.choice(len(book), 4, replace=False)
        new[some] = rng.integers(-6, 7, (4, 2))
        moved[some] = (new[some] != book[some]).any(axis=1)
        compared = vc.recode(x, code, distance, new, moved)
        book = new
        at, d = vc.nearest(x, book)
        assert (at == code).all() and (d == distance).all() and compared < 0.4 * len(x) * len(book)


def test_lengths_that_cannot_be_cut(spark):
    rows = [(0, [1.0] * 3, 1), (1, [], 1), (2, [0.5] * 4, 1), (3, [0.25] * 8, 1), (4, [0.75] * 4, None)]
    got, books = vc.compress(spark.createDataFrame(rows, SCHEMA), parts=4)
    assert {r.vec_id for r in got.collect()} == {2, 4} and books.shape == (4, 2, 1)


def test_empty_table_and_wrong_entries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vc.compress(empty)[0].count() == 0
    with pytest.raises(ValueError):
        vc.compress(empty, entries=257)


def test_query_and_its_twin_on_edge_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, v, None if j % 5 == 0 else j % 3) for j, (i, v) in enumerate(small_rows(64, 80)) if i is not None] + [(1000 + i, float32(rng.normal(1, 0.1, 64).tolist()), 9) for i in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duck(str(tmp_path / "other"))
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    line, ok = compare(spark, "op12", vc.op12_vector_codes, vc.SQL, str(tmp_path), con)
    assert ok, line
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert vc.op12_vector_codes(spark, str(tmp_path / "none")).count() == 0
