import random

from irforge.llm import decontamination as dc
from tests.llm.rows import docs_frame, edge_docs, sf_docs

ITEMS = [(i, " ".join(f"q{i}w{j}" for j in range(n))) for i, n in enumerate((1, 2, 3, 5, 8, 15, 22, 40, 59))] + [(90, None), (91, ""), (92, "  "), (None, "q5x " * 9), (8, "again " * 12)]


def items_frame(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


def least_edits(item, words, limit):
    return min((dc.edits_to_start(item, words[s:s + len(item) + limit], limit) for s in range(max(1, len(words)))), default=limit + 1)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_edits_to_start_equals_plain_dynamic_programme():
    rng = random.Random(4)
    for _ in range(500):
        a = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        b = [rng.randrange(3) for _ in range(rng.randint(0, 12))]
        limit = rng.randint(0, 4)
        best = min(plain_edits(a, b))
        assert dc.edits_to_start(a, b, limit) == (best if best <= limit else limit + 1)


def test_recall_of_edited_passages():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(12, 60)))) for i in range(60)]
    m = dc.Matcher(items)
    texts, want = [], []
    for i, (_, t) in enumerate(items):
        w = t.split()
        for _ in range(int(dc.MAX_EDITS * len(w))):
            p = rng.randrange(len(w))
            w[p:p + 1] = [[], [rng.choice(vocab)], [w[p], rng.choice(vocab)]][rng.randrange(3)]
        texts.append(" ".join([rng.choice(vocab) for _ in range(30)] + w + [rng.choice(vocab) for _ in range(30)]))
    got = {(r, k): e for r, k, _, e in m.search(texts)}
    for r, t in enumerate(texts):
        for k in range(len(items)):
            item = m.items[k].tolist()
            e = least_edits(item, dc.hashed_words([t])[0].tolist(), m.limit[k])
            if e <= m.limit[k]:
                want.append((r, k))
            assert (r, k) not in got or e <= got[r, k] <= m.limit[k]
    found = sum(w in got for w in want)
    assert len(want) >= 55 and found >= 0.97 * len(want)
    assert set(got) <= set(want)


def test_result_does_not_depend_on_the_batch():
    rows = [t for _, t in sf_docs(60)] + [ITEMS[7][1], "x " + ITEMS[8][1].rsplit(" ", 2)[0]]
    m = dc.Matcher(ITEMS)
    together = sorted((r, k, s, e) for r, k, s, e in m.search(rows))
    alone = sorted((r, k, s, e) for r, t in enumerate(rows) for _, k, s, e in m.search([t]))
    assert together == alone and len(together) == 2


def test_edge_rows_exact_copies_and_slices(spark, monkeypatch):
    rows = edge_docs() + [(100 + i, f"Before, {t.upper()}! After") for i, t in ITEMS[:9]] + [(None, ITEMS[6][1]), (7, ITEMS[6][1]), (7, ITEMS[6][1])] + [(200, "q5x " * 9)]
    want = sorted([(100 + i, i, 0) for i in range(9)] + [(None, 6, 0), (7, 6, 0), (7, 6, 0), (200, None, 0)], key=str)
    docs = docs_frame(spark, rows, item_id="clash", edits=5)
    got = [(r.doc_id, r.item_id, r.edits) for r in dc.leaks(docs, items_frame(spark)).collect()]
    assert sorted(got, key=str) == want
    monkeypatch.setattr(dc.item_slices, "__defaults__", (150,))  # several slices of the items
    assert len(list(dc.item_slices(items_frame(spark)))) > 3
    got = [(r.doc_id, r.item_id, r.edits) for r in dc.leaks(docs, items_frame(spark)).collect()]
    assert sorted(got, key=str) == want
    kept = dc.drop_leaks(docs, items_frame(spark))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in edge_docs()), key=str)


def test_empty_tables(spark):
    assert dc.leaks(docs_frame(spark, []), items_frame(spark)).count() == 0
    assert dc.leaks(docs_frame(spark, edge_docs()), items_frame(spark, [])).count() == 0
    assert dc.drop_leaks(docs_frame(spark, edge_docs()), items_frame(spark, [])).count() == len(edge_docs())
