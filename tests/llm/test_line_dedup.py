import hashlib
from collections import Counter

from irforge.llm import line_dedup as ld
from irforge.llm.base import BLANKS
from tests.llm.rows import docs_frame, edge_docs, sf_docs

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans(UP, UP.lower()))


def brute(rows, min_docs=ld.MIN_DOCS):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if found[key(x)] < min_docs]
        out.append((i, t if len(keep) == len(lines) else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def order(r):
    return tuple((x is not None, x or 0 if not isinstance(x, str) else 0, str(x)) for x in r)


def test_against_brute_force(spark):
    line = " Share THIS post\t"
    rows = edge_docs() + [(100 + i, f"{line}\n\nown {i}\nÉtait là\n{'é' if i % 2 else 'É'}") for i in range(24)] \
        + [(200, "share this post"), (201, "\n\n"), (None, "share this post\nx"), (202, "own 3\nSHARE this post\n" * 300)] + [(300 + i, t) for i, t in sf_docs(120)]
    out = ld.drop_frequent_lines(docs_frame(spark, rows, n_lines="clash", dropped=1, batch=2, d=3, t="x", h=4))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "batch", "d", "t", "h", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    assert sum(g[3] for g in got) > 48


def test_runs_are_merged_over_batches(spark):
    rows = [(i, f"line {i % 7}\nline {i % 3}\nonly {i}") for i in range(60)]
    runs = ld.LineRuns(min_docs=20, fanout=2)
    hashes = ld.line_hashes(docs_frame(spark, rows)).cache()
    for b in range(5):
        runs.add(hashes.where(f"doc_id % 5 = {b}"))
    assert len(runs.levels) > 1
    want = Counter(k for _, t in rows for k in set(t.split("\n")))
    got = {r.h for r in runs.frequent().collect()}
    keys = spark.createDataFrame([(k,) for k, n in want.items() if n >= 20], "k string").selectExpr("xxhash64(k) AS h")
    assert got == {r.h for r in keys.collect()}


def test_production_settings_join_settled_lines_and_build_levels(spark, monkeypatch):
    """With the query's own fan-out and batch count, batches meet settled lines and a second level is compacted."""
    rows = [(i, f"line {i % 7}\nline {i % 3}\nonly {i}\nall") for i in range(400)]
    seen = []
    add = ld.LineRuns.add

    def watched(self, hashes):
        seen.append((self.settled is not None, None))
        add(self, hashes)
        seen[-1] = (seen[-1][0], len(self.levels))

    monkeypatch.setattr(ld.LineRuns, "add", watched)
    out = ld.drop_frequent_lines(docs_frame(spark, rows))
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, t) for i, t, _, _ in brute(rows)}
    assert len(seen) == ld.BATCHES and [s for s, _ in seen] == [False, False, True, True] and seen[-1][1] == 3
    monkeypatch.setattr(ld, "BATCH_LINES", 200)
    seen.clear()
    assert ld.drop_frequent_lines(docs_frame(spark, rows)).count() == 400 and len(seen) == 8


def test_digest_of_kept_text(spark, tmp_path):
    docs_frame(spark, [(1, None), (2, ""), (3, "a\nb")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.op5_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (1, 0, sha("")), 2: (1, 0, sha("")), 3: (2, 0, sha("a\nb"))}


def test_empty_table(spark):
    assert ld.drop_frequent_lines(docs_frame(spark, [])).count() == 0
