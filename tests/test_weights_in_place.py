"""TF-IDF weights are scaled where a document lies; documents that share an id are scaled together."""

import math

import pytest

from irforge.operators import lexical as lex

DOCS = [("a", "red apple red pear"), ("b", "green pear green"), ("c", ""), ("d", None), ("e", "apple apple"), ("f", "blue apple pear red")]


def _weights(docs, rows):
    counts = [(i, {}) for i, _ in rows]
    for (_, c), (_, text) in zip(counts, rows):
        t = (text or "").split()
        for x in t + [" ".join(p) for p in zip(t, t[1:])]:
            c[x] = c.get(x, 0) + 1
    df = {}
    for _, c in counts:
        for x in c:
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log((1 + len(rows)) / (1 + n)) + 1 for x, n in df.items()}
    square = {}
    for i, c in counts:
        square[i] = square.get(i, 0.0) + sum((n * idf[x]) ** 2 for x, n in c.items())
    return sorted((str(i), x, n, round(n * idf[x] / math.sqrt(square[i]), 9)) for i, c in counts for x, n in c.items())


def _got(df):
    return sorted((str(r.docid), r.term, r.tf, round(r.w, 9)) for r in lex.tfidf(df).collect())


@pytest.mark.parametrize("extra", [[], [("a", "red apple red pear"), ("b", "yellow"), ("a", "plum plum")], [(None, "plum apple"), (None, "pear plum")]])
def test_weights_equal_brute_force(spark, extra):
    rows = DOCS + extra
    df = spark.createDataFrame(rows, "docid string, doctext string").repartition(3)
    assert _got(df) == _weights(df, rows)


def test_no_posting_is_shuffled(spark):
    df = spark.createDataFrame(DOCS, "docid string, doctext string")
    plan = lex.tfidf(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_a_cut_vocabulary(spark):
    df = spark.createDataFrame(DOCS, "docid string, doctext string")
    got = lex.tfidf(df, max_features=2).collect()
    assert {r.term for r in got} == {"apple", "pear"} or {r.term for r in got} == {"apple", "red"}
    for d in {r.docid for r in got}:
        assert sum(r.w ** 2 for r in got if r.docid == d) == pytest.approx(1.0)
