import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from irforge.llm import fingerprints as fp
from tests.llm.rows import docs_frame, edge_docs, sf_docs

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def h64(*values):
    """xxhash64 over columns of strings, longs and (as bytes) ints."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed & MASK)
    return signed(seed)


def brute(text):
    """The signature by the definition, with plain loops."""
    t = [h64(x) for x in re.findall(rf"[^\x20\x09-\x0D]{{1,{fp.TOKEN}}}", text)]
    kmers = [h64(a, b) for a, b in zip(t, t[1:])] if len(t) >= 2 else t if t else [h64(text)]
    seen, numbered = {}, []
    for i, k in enumerate(kmers):
        numbered.append((h64(k, struct.pack("<i", seen.get(k, 0))), i))
        seen[k] = seen.get(k, 0) + 1
    # k-mers in order of 33 bits of hash and place; the place in this order breaks ties between ranks
    line = [numbered[i] for _, i in sorted((k >> 31, i) for i, k in enumerate(kmers))]
    out = []
    for order in range(fp.SIZE // 2):
        ranks = sorted((h64(e, struct.pack("<i", order)) >> 31, j) for j, (e, _) in enumerate(line))
        for end in (ranks[:fp.TAKEN], ranks[-fp.TAKEN:]):
            taken = sorted((line[j][1], line[j][0]) for _, j in end)
            out.append(h64(*[e for _, e in taken]) & 0xFFFFFFFF)
    return out


TEXTS = ["", " ", "\t\n", "one", "one two", "a a a a a a a a", "a b " * 300, "x" * 100, "Ünïcödé 中文字 😀 text " * 3, " ".join(f"w{i % 37}" for i in range(900))]


def test_signature_equals_plain_loops(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in sf_docs(40)]
    got = {r.doc_id: r.sig for r in fp.with_signature(docs_frame(spark, rows).select("doc_id", "text"), "text", "sig").collect()}
    for i, t in rows:
        assert got[i] == brute(t), (i, t[:50])


def test_order_and_repetition_count(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(w)), (1, " ".join(w)), (2, " ".join(w[30:] + w[:30])), (3, " ".join(w[:-3] + ["x", "y", "z"])), (4, " ".join(w * 2))]
    sig = {r.doc_id: r.sig for r in fp.with_signature(docs_frame(spark, rows).select("doc_id", "text"), "text", "sig").collect()}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / fp.SIZE
    assert like(0, 1) == 1 and like(0, 3) > 0.5 and like(0, 2) < like(0, 3) and like(0, 4) < 1


def test_likeness_follows_full_order_minhash(spark):
    """Texts that share a run of one word and 150 other words in other surroundings: likeness is near that of 100 plain orders."""
    rng = random.Random(3)
    pairs = []
    for i in range(16):  # a run word for each pair, so that the pairs' errors are independent
        own = [rng.sample([f"v{i}" for i in range(5000)], 150) for _ in range(2)]
        run = [f"same{i}"] * rng.randrange(300, 900)
        pairs.append([" ".join(run + x) for x in own])
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    sig = {r.doc_id: r.sig for r in fp.with_signature(docs_frame(spark, rows).select("doc_id", "text"), "text", "sig").collect()}
    error = []
    for i, p in enumerate(pairs):
        sets = []
        for t in p:
            w, seen, out = t.split(), {}, []
            for k in zip(w, w[1:]):
                out.append((k, seen.get(k, 0)))
                seen[k] = seen.get(k, 0) + 1
            sets.append(out)
        full = 0
        for order in range(100):
            ends = []
            for out in sets:
                least = sorted(range(len(out)), key=lambda j: xxhash.xxh64_intdigest(repr(out[j]), order))[:fp.TAKEN]
                ends.append([out[j] for j in sorted(least)])
            full += ends[0] == ends[1]
        like = sum(x == y for x, y in zip(sig[2 * i], sig[2 * i + 1])) / fp.SIZE
        assert like > 0, i
        error.append(like - full / 100)
    assert abs(sum(error) / len(error)) < 0.08 and max(map(abs, error)) < 0.45


def test_buckets_follow_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 50)
    ids = list(range(2000)) + [2**62]
    bounds = list(range(50, 2000, 50))
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fp._bucket("doc_id", bounds).alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {i: sum(b > i for b in bounds) for i in ids}
    out = fp.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), ["text"])
    assert {r.doc_id: r.next_text for r in out.collect()} == {i: str(ids[k - 1]) for k, i in enumerate(ids)}


def expect(rows):
    """doc_id -> list of (n_chars, sha256 of the edited text, next text)."""
    rows = [(i, t or "") for i, t in rows]
    line = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(line):
        nxt = line[(k + 1) % len(line)][1]
        c = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[:len(t) - c] + nxt[:c]).encode()).hexdigest(), t, t[:len(t) - c] + nxt[:c], nxt))
    for i, t in rows:
        if i is None:
            c = len(t) // 3
            out.append((i, len(t), hashlib.sha256(t[:len(t) - c].encode()).hexdigest(), t, t[:len(t) - c], ""))
    return out


def test_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 10)
    rows = edge_docs() + [(1000 + 7 * i, t) for i, t in sf_docs(60)]
    docs_frame(spark, rows, sig="clash", next_text=1, _b=2, _c=3).write.parquet(str(tmp_path / "documents.parquet"))
    hexed = lambda s: "".join(f"{x:08x}" for x in s)
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / fp.SIZE
    want = [(i, n, sha, hexed(brute(t)), hexed(brute(e)), like(brute(t), brute(e)), like(brute(t), brute(x))) for i, n, sha, t, e, x in expect(rows)]
    got = [tuple(r) for r in fp.op10_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_far_ids_and_one_document(spark):
    ids = [-(2**63), -5, 0, 3, 2**62, 2**63 - 1]
    out = fp.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), ["text"]).collect()
    assert {r.doc_id: r.next_text for r in out} == {i: str(ids[k - 1]) for k, i in enumerate(ids)}
    one = fp.with_next(spark.createDataFrame([(4, "a")], "doc_id long, text string"), ["text"]).collect()
    assert [tuple(r) for r in one] == [(4, "a", "a")]


def test_empty_table(spark, tmp_path):
    docs_frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert fp.op10_fingerprints(spark, str(tmp_path)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fp.op10_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
    assert F is not None
