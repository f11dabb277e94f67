import random

import numpy as np
import pyarrow as pa
import pytest

from irforge.llm import token_counts as tc
from tests.conftest import SF_CHECK
from tests.llm.rows import docs_frame, edge_docs, sf_docs

SIGNS = ["s", "t", "re", "ve", "m", "ll", "d", "S", "٣", "़", "²", "a", "B", "é", " ", "  ", "   ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "1", "2", "'s", "'ll", "'",
         "!", ",.", "<|endoftext|>", "<|endof", "中", "😀", "\x00", "\x01", "\x0b", "\r", "the", "​", "　", "_", "İ", "᠎", "﻿", "ȴ", "ᲊ"]


@pytest.fixture(scope="module")
def cutter():
    return tc.Cutter(tc.tokenizer_path())


def library(cutter, text):
    return len(cutter.tok.encode(text or "", add_special_tokens=False).ids)


def test_pretokens_are_the_library_s(cutter):
    rng = random.Random(5)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 14))) for _ in range(4000)] + [None, ""]
    words, index, row = cutter(pa.array(texts, pa.string()))
    words = np.array(words.to_pylist(), dtype=object)
    for i, t in enumerate(texts):
        assert words[index[row == i]].tolist() == cutter.cut(t or ""), repr(t)
    assert len(set(words)) == len(words)


def test_counts_equal_whole_text_encoding(spark, cutter):
    rng = random.Random(6)
    rows = edge_docs() + [(100 + i, t) for i, t in sf_docs(100)] + [(300 + i, "".join(rng.choices(SIGNS, k=rng.randint(0, 30)))) for i in range(300)]
    # many bounds on the broadcast table: nothing, almost nothing, everything
    for frequent in (1, 40, tc.FREQUENT):
        got = tc.token_counts(docs_frame(spark, rows, n="x", h=1, f=2, row=3, pieces=4, rest=5).repartition(4), frequent=frequent).collect()
        want = [(i, len((t or "").encode()), library(cutter, t)) for i, t in rows]
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key), frequent


def test_the_broadcast_part_is_bounded(spark):
    docs = docs_frame(spark, [(i, " ".join(f"w{j}" for j in range(i))) for i in range(60)])
    vocab = tc.vocabulary(docs, tc.tokenizer_path())
    f = sorted((r.f for r in vocab.collect()), reverse=True)
    for most in (20, 30, 1000):
        known, pieces, least = tc.frequent_counts(vocab, most)
        assert 0 < len(known) == sum(x >= least for x in f) <= most and (known[:-1] < known[1:]).all() and (pieces > 0).all()
        assert all(x * most <= 1.1 * sum(f) for x in f if x < least)


def test_empty_table(spark):
    out = tc.token_counts(docs_frame(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens"]


def test_query_on_the_given_table(spark, cutter):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op13_token_counts(spark, SF_CHECK).collect()}
    rows = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = library(cutter, r.text)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 1024)
