"""Python-string semantics of the text layer on hand-made edge rows (FIXTURES §4)."""

from pyspark.sql import functions as F

from irforge.functions.text import is_ascii, py_split, py_strip, term_frequencies
from irforge.operators import textprep as tp

EDGE = ["", "   ", "a a a", "\tab\n", " x y ", "　mid\u001cdle　", " lead and trail ",
        "Is it?\nYes", "café naïve", "x "]


def test_strip_split_match_python(spark):
    df = spark.createDataFrame([(s,) for s in EDGE], "t string")
    rows = df.select("t", py_strip(F.col("t")).alias("s"), py_split(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r["s"] == r["t"].strip()
        assert list(r["w"]) == r["t"].split()


def test_is_ascii_including_final_line_separator(spark):
    df = spark.createDataFrame([(s,) for s in EDGE], "t string")
    for r in df.select("t", is_ascii(F.col("t")).alias("a")).collect():
        assert r["a"] == r["t"].isascii()


def test_clean_question(spark):
    want = {"What is X? Answer: y Note: z": ("What is X?", True), "two\nwords": ("twowords", True), "  Explanation: only": ("", False),
            "Café question?": ("Café question?", False), "Example 1: In each case": ("", False), "plain question": ("plain question", True)}
    df = spark.createDataFrame([(q,) for q in want], "q string")
    out = df.select("q", tp.clean_question(F.col("q")).alias("c"), tp.keep_question(tp.clean_question(F.col("q"))).alias("k")).collect()
    assert {r["q"]: (r["c"], r["k"]) for r in out} == want


def test_extract_question_and_llm_output(spark):
    marked = {"blah Query: first? Query: last one\nmore": "last one?", "no marker here": "no marker here?", "Query:  spaced  \n": "spaced?"}
    df = spark.createDataFrame([(o,) for o in marked], "o string")
    assert {r["o"]: r["q"] for r in df.select("o", tp.extract_question(F.col("o")).alias("q")).collect()} == marked
    raw = {"blah Query: first? Query: last one\nmore": "Query: first", "blah why Answer: so": "why", "plain\nrest": "plain", "blah x Example 5: y": "x"}
    df = spark.createDataFrame([(o, "blah") for o in raw], "o string, p string")
    assert {r["o"]: r["c"] for r in df.select("o", tp.clean_llm_output(F.col("o"), F.col("p")).alias("c")).collect()} == raw


def test_merge_title_text(spark):
    rows = [(None, "body "), ("  ", " body"), ("Title", "body"), ("T", "")]
    df = spark.createDataFrame(rows, "title string, text string")
    for r in df.select("title", "text", tp.merge_title_text(F.col("title"), F.col("text")).alias("m")).collect():
        t, x = (r["title"] or "").strip(), (r["text"] or "").strip()
        assert r["m"] == ((t + " " + x).strip() if t else x)


def test_term_frequencies(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "t array<string>")
    rows = df.select(term_frequencies(F.sort_array("t")).alias("tf")).collect()
    assert [(x["term"], x["tf"]) for x in rows[0]["tf"]] == [("a", 1), ("b", 3), ("c", 1)]
    assert rows[1]["tf"] == []
