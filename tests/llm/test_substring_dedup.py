import random

import pytest

from irforge.llm import substring_dedup as sd
from tests.llm.rows import docs_frame, edge_docs, sf_docs


def brute(rows):
    """{(doc_id, text): (text, n_removed)} by comparing all spans of all documents directly."""
    docs = sorted({(i is not None, i, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1] or 0, d[2]))
    seen, marks = {}, {}
    for _, i, t in docs:
        s = sd.sentences(t)
        words = [x.lower().split() for x in s]
        n = [len(w) for w in words]
        found = set()
        for a in range(len(s)):
            b = next((b for b in range(a, len(s)) if sum(n[a:b + 1]) >= sd.MIN_WORDS), None)
            if b is not None:
                found.add((a, b))
            c = next((c for c in range(a, -1, -1) if sum(n[c:a + 1]) >= sd.MIN_WORDS), None)
            if c is not None:
                found.add((c, a))
        for a, b in sorted(found):
            key = tuple(map(tuple, words[a:b + 1]))
            seen.setdefault(key, (i, t, a))
            if seen[key] != (i, t, a):
                marks.setdefault((i, t), set()).update(range(a, b + 1))
    out = {}
    for i, t in rows:
        gone = marks.get((i, t), set())
        out[i, t] = (t if t is None else "".join(x for k, x in enumerate(sd.sentences(t)) if k not in gone), len(gone))
    return out


def test_sentences_make_up_the_text():
    for t in ["", "a", "A b. C d!\n\n e?f g.. h", " " * 50, "w " * 100 + ". x", "\n\n a\n", "1.5 apples. Then"]:
        assert "".join(sd.sentences(t)) == t
    assert sd.sentences("A b. C d!\ne") == ["A b. ", "C d!\n", "e"]
    assert max(len(s.split()) for s in sd.sentences("w " * 100)) == sd.MAX_WORDS


def test_against_brute_force(spark):
    rows = sf_docs(200)
    got = {r.doc_id: (r.text, r.n_removed) for r in sd.drop_repeats(docs_frame(spark, rows, d=1, t="x", h=2, cut=3)).select("doc_id", "text", "n_removed").collect()}
    want = brute(rows)
    # the same hash kept in two documents at the same place of id order is the only freedom; there is none here
    assert got == {i: want[i, t] for i, t in rows}
    assert sum(n for _, n in got.values()) > 0


def test_first_passage_stays_and_others_go(spark):
    passage = " ".join(f"w{i} x{i}." if i % 5 == 4 else f"w{i} x{i}" for i in range(30))
    rows = [(i, f"own{i} start here. {passage} own{i} end here.") for i in range(5)] + [(9, "A clean text. With two sentences.")]
    got = {r.doc_id: r.text for r in sd.drop_repeats(docs_frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[5][1]
    for i in range(1, 5):
        assert got[i] == f"own{i} start here. own{i} end here."


def test_edge_rows(spark):
    rows = edge_docs()
    got = sd.drop_repeats(docs_frame(spark, rows)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.text), r.n_removed) for r in got if r.doc_id is not None and r.text is not None) == \
        sorted(((i, want[i, t][0]), want[i, t][1]) for i, t in rows if i is not None and t is not None)
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert sd.drop_repeats(docs_frame(spark, [])).count() == 0


def test_passages_without_punctuation_at_random_offsets(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passages = [[word() for _ in range(55)] for _ in range(40)] + [["no"] * 30 + [word()] * 25, ["ab", "cd", "ef"] * 19]

    def planted(p):
        before, after = ([word() for _ in range(rng.randrange(1, 60))] for _ in range(2))
        return " ".join(before + p + after)

    rows = [(2 * k + d, planted(p)) for k, p in enumerate(passages) for d in range(2)]
    got = {r.doc_id: r for r in sd.drop_repeats(docs_frame(spark, rows)).collect()}
    for i, t in rows:
        gone = len(t.split()) - len(got[i].text.split())
        if i % 2:
            assert 24 <= gone <= len(passages[i // 2]), (i, t)
        elif i // 2 < len(passages) - 1:  # the last passage repeats itself
            assert got[i].text == t
