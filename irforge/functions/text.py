"""String functions with Python ``str`` semantics, built from JVM-side Spark expressions.

Spark's ``trim`` removes only U+0020 and Java's ``\\s`` is ASCII-only, while Python ``strip()`` and
``split()`` use Unicode whitespace.  ``WS`` below is the set of BMP code points for which Python's
``str.isspace()`` is true; the same class is used in the DuckDB oracle so both engines agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python isspace() code points (BMP) as a regex class, and the word-token pattern
# (runs of >= 2 letters, digits or underscores, i.e. Python's \b\w\w+\b on lower-cased text).
WS = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]"
NON_WS_RUN = r"[^\x09-\x0d\x1c-\x1f\x85\p{Z}]+"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+\z", "")


def py_rstrip(c) -> Column:
    """``str.rstrip()``."""
    return F.regexp_replace(_c(c), rf"{WS}+\z", "")


def py_split(c) -> Column:
    """``str.split()`` with no separator: runs of non-whitespace."""
    return F.regexp_extract_all(_c(c), F.lit(NON_WS_RUN), 0)


def ws_token_count(c) -> Column:
    """``len(t.split())``."""
    return F.size(py_split(c))


def word_tokens(c) -> Column:
    """Lower-cased word tokens of length >= 2 (scikit-learn's default token pattern)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_TOKEN), 0)


def first_tokens(c, n: int) -> Column:
    """``' '.join(t.split()[:n])``."""
    return F.array_join(F.slice(py_split(c), 1, n), " ")


def before_first(c, sep: str) -> Column:
    """``s.split(sep)[0]``: the part before the first occurrence (whole string if absent)."""
    return F.substring_index(_c(c), sep, 1)


def after_last(c, sep: str) -> Column:
    """``s.split(sep)[-1]``."""
    return F.substring_index(_c(c), sep, -1)


def cut_at_each(c, phrases: list[str], strip_each: bool = False) -> Column:
    """Fold ``s = s.split(p)[0]`` (optionally stripped) over the phrases in order."""
    def step(acc, p):
        out = before_first(acc, p)
        return py_strip(out) if strip_each else out
    return reduce(step, phrases, _c(c))


def is_ascii(c) -> Column:
    """``str.isascii()``; note ``rlike`` finds a match anywhere, so no anchors are needed."""
    return ~_c(c).rlike(r"[^\x00-\x7F]")


def term_frequencies(tokens: Column) -> Column:
    """Sorted array<string> -> array<struct<term, tf>> without exploding or shuffling.

    Reads run lengths of an already sorted token array (sort it with ``sort_array`` in an earlier
    projection), O(n) per row inside the JVM.  ``tokens`` must be a column reference, not an
    expression, so that it is not re-evaluated inside the lambdas.
    """
    n = F.size(tokens)
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    starts = F.filter(idx, lambda i: (n > 0) & ((i == 1) | (F.element_at(tokens, i) != F.element_at(tokens, F.greatest(i - 1, F.lit(1))))))
    ends = F.filter(idx, lambda i: (n > 0) & ((i == n) | (F.element_at(tokens, i) != F.element_at(tokens, F.least(i + 1, n)))))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.element_at(tokens, s).alias("term"),
                                                          (e - s + 1).cast("long").alias("tf")))
