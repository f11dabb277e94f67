import numpy as np
import pytest

import corpus_pipeline as cp
from irforge.llm import decontamination as dc
from irforge.llm import packing as pk
from tests.conftest import SF_SMALL
from tests.llm.rows import docs_frame, edge_docs
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_line_dedup import brute as lines


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small documents with a frequent line, near copies, leaks and edge rows, and the other tables."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    docs = [(i, t + "\nshare this on every network" if i % 9 == 0 else t) for i, t in docs]
    docs += [(10_000 + i, f"{t.replace(' ', '  ')} and some more") for i, t in docs[50:60]] + [(20_000 + i, f"Look: {t} Good.") for i, t in enumerate(items[:5])] + [(-1 - (i or 0), t) for i, t in edge_docs()]
    docs_frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stage = dict(cp.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    clean = cp.materialize(stage["toxicity"](spark, docs, corpus))
    toxic = {r.doc_id for r in spark.read.parquet(f"{corpus}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    assert clean.columns == docs.columns and not (gone & labelled) - toxic and len(gone & toxic) >= len(toxic) / 2

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    fewer = cp.materialize(stage["line_dedup"](spark, clean, corpus))
    assert fewer.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in fewer.collect()), key=str) == sorted([(i, t) for i, t, _, _ in lines(rows)], key=str)

    rows = [(r.doc_id, r.text) for r in fewer.collect()]
    one = cp.materialize(stage["ngram_jaccard_join"](spark, fewer, corpus))
    want = sorted(d for (d, _), (n, c) in zip(rows, components(rows)) if not n or d == c)
    assert one.columns == docs.columns and len(want) < len(rows)
    got = sorted(r.doc_id for r in one.collect())
    assert sorted(set(got)) == sorted(set(want))

    rows = [(r.doc_id, r.text) for r in one.collect()]
    m = dc.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()])
    leaked = set()
    for i, t in rows:
        w = dc.hashed_words([t])[0].tolist()
        if any(item[0] in w and any(w[s:s + len(item)] == item for s in range(len(w) - len(item) + 1)) for item in (x.tolist() for x in m.items)):
            leaked.add(i)
    free = cp.materialize(stage["decontamination"](spark, one, corpus))
    kept = {r.doc_id for r in free.collect()}
    assert free.columns == docs.columns and leaked and not kept & leaked
    assert kept == {i for i, t in rows if not m.search([t])}

    rows = [(r.doc_id, r.text) for r in free.collect()]
    out = stage["packing"](spark, free, corpus).toPandas()
    tok = pk.ChunkTokenizer(pk.tokenizer_path()).tok
    for i, t in rows[:40]:
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in out[out.doc_id == i].sort_values("start").ids])
        assert ids.tolist()[: len(ids) // sum(d == i for d, _ in rows)] == (tok.encode(t or "", add_special_tokens=False).ids + [1])[: len(ids) // sum(d == i for d, _ in rows)]
    assert set(out.doc_id) == {i for i, _ in rows} and out.sequence_id.is_unique


def test_run_applies_all_stages(spark, corpus):
    out = cp.run(spark, corpus)
    assert {"doc_id", "start", "length", "ids", "sequence_id"} <= set(out.columns) and out.count() > 100


def test_empty_documents(spark, corpus, tmp_path):
    docs_frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
