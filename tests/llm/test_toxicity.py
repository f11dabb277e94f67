import numpy as np

from irforge.llm import toxicity as tx
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.rows import docs_frame, edge_docs

CORPUS = ["the silly goose was an idiot and a loser in the trash"] * 50 + ["letters make words and words make sentences that people read"] * 50


def logp():
    n = tx.trigram_counts(CORPUS).reshape((28,) * 3) + 0.5
    return np.log(n / n.sum(axis=2, keepdims=True))


def brute_decode(token, lp):
    """The best of all paths through the lattice."""
    paths = [("", 0.0)]
    for options in tx.lattice(token):
        paths = [(w + s, p + c) for w, p in paths for s, c in options]

    def value(word, cost):
        x = y = 0
        for z in [*map(tx.char_class, word), 0]:
            cost += lp[x, y, z]
            x, y = y, z
        return cost

    return max(value(w, p) for w, p in paths)


def test_viterbi_equals_all_paths():
    lp = logp()
    for t in ("1d10t", "l0s3r", "tr4sh", "iddddiot", "66!|ll8", "$1lly", "é1ttérs", "a", "ooo000"):
        word = tx.decode(t, lp)
        best = brute_decode(t, lp)
        paths = [("", 0.0)]
        for options in tx.lattice(t):
            paths = [(w + s, p + c) for w, p in paths for s, c in options]

        def value(w, c):
            x = y = 0
            for z in [*map(tx.char_class, w), 0]:
                c += lp[x, y, z]
                x, y = y, z
            return c

        assert abs(max(value(w, c) for w, c in paths if w == word) - best) < 1e-9


def test_disguised_words_are_restored():
    d = tx.Decoder(logp())
    for t, w in (("1d10t", "idiot"), ("l0ser!", "loser"), ("tr4sh", "trash"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("l-0-s-e-r", "loser")):
        assert w in d.words(t), t
    assert d.words("plain,") == ["plain"] and d.words("***") == [] and d.words("") == []
    assert "idiot" in d.joined(list("id10t")) and d.joined(list("123")) == [] and d.joined(["a", "b"]) == []


def test_trigram_counts_follow_a_plain_count():
    texts = ["Ab é!", None, "", "b"]
    want = np.zeros((28,) * 3, dtype=int)
    s = "ab é!   b  "
    c = [tx.char_class(x) for x in "ab é! b  "]
    for a, b, z in zip(c, c[1:], c[2:]):
        want[a, b, z] += 1
    assert (tx.trigram_counts(texts).reshape((28,) * 3) == want).all() and s


def test_lexicon_levels_equal_all_levels():
    lp = logp()
    texts = ["an idiot, an IDIOT and i d i o t", "1d10t idiocy idiots", None, "", "a b", "x y z idiot " * 9, "no such word"]
    d = tx.Decoder(lp)
    every = list(tx.all_levels(tx.Tokens(texts), d))
    bounds = {f: 2.5 for own in every for f in own if f.startswith("idi")}
    m = tx.ToxicityModel(lp, bounds, dict.fromkeys([*bounds, *tx.STEPS], 0.1), -1.0)
    got = m.found(texts, d)
    assert [sorted(f for f in own if f in bounds) for own in every] == [sorted(f for f in own if f not in tx.STEPS) for own in got]
    assert "idiot#2" in got[0] and "idiot#4" not in got[0] and "=most2" in got[0] and "=most3" not in got[0] and got[2] == got[3] == []
    assert [m.scores([t], d)[0] for t in texts] == m.scores(texts, d)


def test_held_out_quality(spark):
    out = {r.doc_id: r for r in tx.op9_toxicity(spark, SF_CHECK).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()]
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert len(out) == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 1


def test_edge_rows_and_missing_labels(spark, tmp_path):
    rows = edge_docs()
    docs_frame(spark, rows, score="clash", y=1, toxic=0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = tx.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and {(r.score, r.predicted) for r in out} == {(0.0, 0)}
    model = tx.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    got = docs_frame(spark, rows).select("doc_id", "text", tx.scorer(docs_frame(spark, rows), model)("text").alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s < 0.7 for r in got) and len({r.s for r in got if not r.text}) == 1
    docs_frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert tx.op9_toxicity(spark, str(tmp_path / "none")).count() == 0


def test_disguises_of_any_length_in_brackets_and_spaced_words():
    d = tx.Decoder(logp())
    for t, w in (("idi" + "o" * 40 + "t", "idiot"), ("i--d--i--o--t", "idiot"), ("s---e---n---t---e---n---c---e", "sentence"), ("idiooooot!", "idiot"), ("looooser!!", "loser"),
                 ("(idiooooot)", "idiot"), ("(1d10t)", "idiot"), ("[l0ser!]", "loser"), ("(i.d.i.o.t)", "idiot"), ("l-0-s-e-r!", "loser")):
        assert w in d.words(t), (t, d.words(t))
    assert d.words("(idiot)") == ["idiot"] and not any(w.startswith("c") for w in d.words("(idiooooot)"))
    assert {"an", "idiot"} <= set(d.joined(list("anidiot"))) and "sentences" in d.joined(list("wordsmakesentencesthatpeopleread"))
    assert "".join(d.joined(list("ab1" * 20000))[:1]).isalpha()
