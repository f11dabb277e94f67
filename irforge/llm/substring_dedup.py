"""Substring dedup by sliding sentence spans.

A text is cut into sentences: up to a full stop, question or exclamation mark before white space, or
a line end.  Sentences are cut further where the hash of two neighbouring words is a local minimum
(and after ``MAX_WORDS`` words in any case), so that a passage is cut alike wherever it stands, also
if it begins in mid-sentence or has no punctuation.  A span is a run of consecutive sentences with at least ``MIN_WORDS`` words that is shortest
from its first or to its last sentence, so every run of that many words has all its sentences
covered.  Spans are hashed over the words' lower-case form.

1. Count the hashes of all spans; the repeated ones go into a fixed-size bitmap.
2. Spans that the bitmap lets through meet in a join on the hash: the first by (doc_id, place) stays,
   every other one marks its sentences.
3. The marked sentences of a document return to it and are cut from its text.

Hash counts combine before the shuffle, the joins split hot hashes (adaptive skew join), and a
document's marks are bounded by its own length.

Defined cases: null or empty text is unchanged; rows that repeat id and text are one document and
come out alike; null ids sort first; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import Bitmap, documents, mix, word_hashes
from irforge.session import materialize

MIN_WORDS = 24
MAX_WORDS = 16
#: Places on either side among which a cut has the least hash: cuts are 2 * NEAR + 1 words apart on average.
NEAR = 3
ROWS = 512
_SENTENCE = re.compile(r".*?(?:[.!?]+(?=\s|\Z)\s*|\n\s*|\Z)", re.S)
_WORD = re.compile(r"\S+\s*")
_BASE = 0x9E3779B97F4A7C15
#: White space beyond that of ``word_hashes``.
_SPACE = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def words_of(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in lower case, words of each sentence)."""
    return word_hashes(pc.replace_substring_regex(pc.utf8_lower(pa.array(sentences, pa.string())), _SPACE, " "))


def cut_places(own: np.ndarray, size: np.ndarray, max_words: int = MAX_WORDS) -> np.ndarray:
    """Places in the words of hashes ``own`` (sentences of ``size`` words) before which a sentence is cut.

    A place is cut if the hash of its word and the word before is the least among the ``NEAR`` places on
    either side, or if a run of one word begins or ends there, so equal passages are cut alike whatever
    precedes them; longer gaps are cut every ``max_words`` words."""
    end = np.cumsum(size)
    n = int(end[-1])
    pair = mix(own + np.concatenate([[np.uint64(0)], own[:-1]]) * np.uint64(_BASE))
    place = np.arange(n) - np.repeat(end - size, size)
    least = (place > NEAR) & (place < np.repeat(size, size) - NEAR)
    for d in range(1, NEAR + 1):
        # of equal neighbours none is least: a run of one word has no place of its own
        least[d:] &= pair[d:] < pair[:-d] if d == 1 else pair[d:] <= pair[:-d]
        least[:-d] &= pair[:-d] <= pair[d:]
    # a run of one word is cut where it begins and ends
    same = np.append((own[1:] == own[:-1]) & (place[1:] > 0), False)  # with the next one
    run = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(NEAR, dtype=bool), same, np.zeros(NEAR - 1, dtype=bool)]), NEAR).all(axis=1)
    ahead, behind = run[NEAR:], run[:n]  # the next NEAR words are the same; the NEAR words before the last one were it
    changed = np.concatenate([[False], ~same[:-1]])
    cuts = np.union1d(np.flatnonzero(least | changed & (ahead | np.concatenate([[False], behind[:-1]]))), end - size)
    gap = np.diff(cuts, append=n)
    more = [np.arange(c + max_words, c + g, max_words) for c, g in zip(cuts[gap > max_words], gap[gap > max_words])]
    return np.sort(np.concatenate([cuts, *more]))


def pieces(texts: list[str | None], max_words: int = MAX_WORDS) -> list[list[str]]:
    """The consecutive pieces that make up each text."""
    out, long = [], []
    for t in texts:
        own = [s for s in _SENTENCE.findall(t or "") if s]
        long += [(own, k) for k, s in enumerate(own) if len(s) > 4 * NEAR]
        out.append(own)
    if long:
        words, sizes = words_of([own[k] for own, k in long])
        some = sizes > 2 * NEAR + 1
        long, words, sizes = [x for x, b in zip(long, some.tolist()) if b], words[np.repeat(some, sizes)], sizes[some]
    if long:
        cuts = cut_places(words, sizes, max_words)
        end = np.cumsum(sizes)
        upto = np.searchsorted(cuts, end).tolist()
        cuts, at = cuts.tolist(), 0
        for (own, k), e, n, u in zip(long, end.tolist(), sizes.tolist(), upto):
            if u - at > 1:
                w = _WORD.findall(own[k])
                w[0] = own[k][:len(own[k]) - sum(map(len, w))] + w[0]
                here = [c - e + n for c in cuts[at:u]] + [n]
                own[k] = ["".join(w[i:j]) for i, j in zip(here, here[1:])]
            at = u
        out = [[x for s in own for x in ([s] if isinstance(s, str) else s)] for own in out]
    return out


def sentences(text: str | None, max_words: int = MAX_WORDS) -> list[str]:
    """Consecutive pieces that make up the text."""
    return pieces([text], max_words)[0]


def sentence_hashes(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the words in lower case, number of words) of each sentence."""
    w, count = words_of(sentences)
    end = np.cumsum(count)
    place = np.arange(len(w)) - np.repeat(end - count, count)
    powers = np.cumprod(np.full(int(count.max(initial=0)) + 1, _BASE, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w * powers[place])])
    return mix(sums[end] - sums[end - count] + count.astype(np.uint64)), count


def spans(texts: list[str | None], min_words: int = MIN_WORDS, max_words: int = MAX_WORDS):
    """(row, hash, first sentence, last sentence) as arrays, over all texts at once."""
    own = pieces(texts, max_words)
    row = np.repeat(np.arange(len(own)), [len(s) for s in own])
    if not len(row):
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64))
    unit, count = sentence_hashes([s for part in own for s in part])
    total = np.concatenate([[0], np.cumsum(count)])
    start = np.searchsorted(row, row, "left")
    n = len(row)
    powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(unit * powers)])
    back = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    here = np.arange(n)
    to = np.searchsorted(total, total[:-1] + min_words, "left") - 1  # shortest from here
    since = np.searchsorted(total, total[1:] - min_words, "right") - 1  # shortest to here
    ahead = to < n
    ahead[ahead] &= row[to[ahead]] == row[ahead]
    behind = (since >= 0) & (total[1:] >= min_words)
    behind[behind] &= row[since[behind]] == row[behind]
    first = np.concatenate([here[ahead], since[behind]])
    last = np.concatenate([to[ahead], here[behind]])
    key = np.unique(first * n + last)
    first, last = key // n, key % n
    h = mix((sums[last + 1] - sums[first]) * back[first])
    return row[first], h, first - start[first], last - start[first]


def mark_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, covered): the sentence intervals under non-first repeated spans."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(spans(b.column(0).slice(at, ROWS).to_pylist(), min_words)[1].view(np.int64))], names=["h"])

    counts = docs.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    repeated = Bitmap(counts.where("n >= 2"), "h")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                row, h, first, last = spans(part.column(2).to_pylist(), min_words)
                k = np.flatnonzero(repeated.has(h))
                row = pa.array(row[k])
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(h[k].view(np.int64)), pa.array(first[k]), pa.array(last[k])],
                                                 names=["doc_id", "text_hash", "h", "first", "last"])

    found = materialize(keyed.mapInArrow(hits, f"doc_id {id_type}, text_hash long, h long, first long, last long"))
    place = F.struct("doc_id", "text_hash", "first")
    # written, so that the join below is between two plain shuffles, which the skew join can split
    firsts = materialize(found.groupBy("h").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n"))
    others = found.join(firsts, "h").where(~place.eqNullSafe(F.col("kept")))
    return others.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("covered"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the covered sentences cut from text, plus n_removed (sentences).

    Input columns called text_hash, covered, cut, n_removed, _span_doc or _span_text give way.
    """
    docs = docs.drop("text_hash", "covered", "cut", "n_removed", "_span_doc", "_span_text")
    marks = mark_repeats(docs, min_words).withColumnsRenamed({"doc_id": "_span_doc", "text_hash": "_span_text"})
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    both = keyed.join(marks, keyed.doc_id.eqNullSafe(marks._span_doc) & (keyed.text_hash == marks._span_text), "left")

    @F.pandas_udf("text string, n_removed long")
    def cut(text: pd.Series, covered: pd.Series) -> pd.DataFrame:
        out, gone = [], []
        for t, c in zip(text, covered):
            if c is None or t is None:
                out.append(t)
                gone.append(0)
                continue
            s = sentences(t)
            drop = np.zeros(len(s), dtype=bool)
            for x in c:
                drop[x["first"]:x["last"] + 1] = True
            out.append("".join(x for x, d in zip(s, drop) if not d))
            gone.append(int(drop.sum()))
        return pd.DataFrame({"text": out, "n_removed": gone})

    out = both.withColumn("cut", cut("text", "covered"))
    return out.select(*[F.col("cut.text").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col("cut.n_removed").alias("n_removed"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
