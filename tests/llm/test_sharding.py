import zlib
from collections import Counter

from irforge.llm import sharding as sh
from tests.llm.rows import docs_frame, edge_docs, sf_docs


def test_rows_slots_and_laws(spark, tmp_path):
    rows = edge_docs() + [(2**62 + 1, None), (-(2**62) - 1, "far")] + [(100 + i, t) for i, t in sf_docs(150)]
    docs_frame(spark, rows, shard=9, slot="x", bucket=1).write.parquet(str(tmp_path / "documents.parquet"))
    out = sh.op3_sharding(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, size(t), crc(t)) for i, t in rows)
    for s in range(sh.SHARDS):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.law for r in out} == {"key"}
    assert all(r.grown_shard in (r.shard, sh.SHARDS) for r in out) and 0 < sum(r.grown_shard == sh.SHARDS for r in out) < len(out) / 4
    of = {}
    for r in out:
        assert of.setdefault(r.doc_id, r.shard) == r.shard


def test_many_buckets_are_shuffled_and_repeatable(spark, tmp_path):
    docs = docs_frame(spark, [(i, "x" * (i % 50)) for i in range(600)]).repartition(5)
    one = sh.shuffle_shards(docs, 2, bucket_bytes=2000)
    a = {r.doc_id: (r.shard, r.bucket, r.slot) for r in one.collect()}
    b = {r.doc_id: (r.shard, r.bucket, r.slot) for r in sh.shuffle_shards(docs.repartition(3), 2, bucket_bytes=2000).collect()}
    assert a == b and len({(s, k) for s, k, _ in a.values()}) > 6
    for s in (0, 1):
        slots = sorted((v[2], i, v[1]) for i, v in a.items() if v[0] == s)
        assert [x[0] for x in slots] == list(range(len(slots)))
        assert [x[1] for x in slots] != sorted(x[1] for x in slots)
        assert [x[2] for x in slots] == sorted(x[2] for x in slots)
    c = {r.doc_id: (r.shard, r.bucket, r.slot) for r in sh.shuffle_shards(docs, 2, seed=5, bucket_bytes=2000).collect()}
    assert c != a
    sh.write_shards(one, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600


def test_empty_table(spark):
    assert sh.shuffle_shards(docs_frame(spark, [])).count() == 0
