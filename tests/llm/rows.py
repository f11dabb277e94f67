"""Rows for the operators' tests: a slice of the given documents and hand-made edge rows."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sf_docs(n):
    t = pq.read_table(f"{SF_SMALL}/documents.parquet").slice(0, n).to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def edge_docs():
    """Nulls in id and text, empty, blank and very long texts, exact copies, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    copy = "the quick brown fox jumps over the lazy dog near the old stone bridge at noon while seven small birds sing in a tall green tree by the river."
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, long), (6, copy), (7, copy), (7, copy), (8, copy + " More."),
            (None, copy), (None, None), (10, "a a a a a a a a"), (11, "x" * 5000), (12, "Ünïcödé ﬁ 中文 😀 text")]


def docs_frame(spark, rows, **extra):
    """The documents' columns, and any extra constant columns."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df
