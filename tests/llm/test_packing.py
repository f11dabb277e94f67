import ctypes
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from irforge.llm import packing as pk
from irforge.llm.base import release_memory
from tests.llm.rows import docs_frame, edge_docs, sf_docs


@pytest.fixture(scope="module")
def tok():
    return pk.ChunkTokenizer(pk.tokenizer_path())


def test_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        parts = pk.binary_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts) and parts == sorted(parts, reverse=True)
        assert len(set(p for p in parts if p < 2048)) == len([p for p in parts if p < 2048])


def test_ids_equal_whole_text_encoding(tok):
    rng = random.Random(2)
    signs = ["a", "B", "é", "É", "é", "́", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "1", "2", "'s", "'", "!", ",.", "<|endoftext|>",
             "<|startoftext|>", "ﬁ", "Σ", "ς", "ß", "İ", "ÿ", "Þ", "×", "÷", "中", "😀", "\x00", "\x0b", "\x0c", "\r", "the", "‍", "Ä", "ñ", "_", "`"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    ids, begin = tok(pa.array(texts))
    for t, a, b in zip(texts, begin[:-1], begin[1:]):
        assert ids[a:b].tolist() == tok.tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_table_is_small(tok):
    texts = pa.array([" ".join(np.base_repr(7**9 + 31 * i, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")).lower() for i in range(k, k + 500)) for k in range(0, 60_000, 500)])
    tok(pa.array(["warm up"]))
    tok.forget()
    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0]
        for at in range(0, len(texts), 20):
            tok(texts.slice(at, 20))
        held = pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert len(tok.known) == 60_001 and held < 60_000 * 60
    tok.forget()


def test_emptied_table_gives_the_same_ids(tok, monkeypatch):
    monkeypatch.setattr(pk, "TABLE", 1000)
    tok.forget()
    texts = [t or "" for _, t in sf_docs(40)]
    for at in range(0, 40, 4):
        ids, begin = tok(pa.array(texts[at:at + 4]))
        for t, a, b in zip(texts[at:at + 4], begin[:-1], begin[1:]):
            assert ids[a:b].tolist() == tok.tok.encode(t, add_special_tokens=False).ids
    tok.forget()


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library can't give memory back")
def test_free_memory_goes_back():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10

    many = [bytes(600) for _ in range(100_000)]
    full = resident()
    last = many.pop()
    del many
    release_memory()
    assert len(last) == 600 and full - resident() > 40


def test_pieces_make_up_the_documents(spark, tok, tmp_path):
    rows = edge_docs() + [(100 + i, t) for i, t in sf_docs(100)]
    out = pk.pack(docs_frame(spark, rows, length=1, ids="x", bucket=3)).toPandas()
    whole = {i: tok.tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    assert out.sequence_id.is_unique and (out.offset == 0).all() and (out.length == 2 ** out.bucket).all()
    single = out[out.doc_id.notna() & (out.doc_id != 7)]
    for i, own in single.groupby("doc_id"):
        own = own.sort_values("start")
        got = np.concatenate([np.frombuffer(b, "<u4") for b in own.ids])
        assert got.tolist() == whole[i] and (own.doc_tokens == len(whole[i])).all() and own.length.tolist() == pk.binary_lengths(len(whole[i]))
    assert len(out) == sum(len(pk.binary_lengths(len(tok.tok.encode(t or "", add_special_tokens=False).ids) + 1)) for _, t in rows)
    docs_frame(spark, rows[:4]).write.parquet(str(tmp_path / "documents.parquet"))
    digest = pk.op7_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in digest if r.doc_id == 2} == {2: zlib.crc32(np.array([1], "<u4").tobytes())}


def test_buckets_of_equal_length(spark, tmp_path):
    pk.write_buckets(pk.pack(docs_frame(spark, sf_docs(30))), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("length != pow(2, bucket)").count() == 0 and back.count() > 30


def test_empty_table(spark):
    assert pk.pack(docs_frame(spark, [])).count() == 0
