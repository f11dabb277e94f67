"""Language ID by mixture inference.

Training counts character trigrams of words (with word ends) for every language of the labelled
training documents, all of them, in ``SLOTS`` hash slots; the counts combine on the workers and in the
shuffle, and languages x slots sums reach the driver.  A language's model is the smoothed share of
each slot.

A document is a mixture of languages.  A word's likelihood under a language is the product of its
trigrams'; expectation-maximisation estimates the languages' proportions from the words' likelihoods.
The set of languages is grown from the best single one: a language joins while it raises the
log-likelihood by more than ``PENALTY * log(words)``.  The prediction is the language with the largest
proportion, and the proportion is its score.

Defined cases: null text, text without a letter, and any text when nothing was learned are ``und``
with score 0; training rows with null text, language or id are left out; repeated rows are predicted
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import crc_mod, documents

BITS = 16
SLOTS = 1 << BITS
SMOOTH = 0.5
PENALTY = 1.5
ROUNDS = 30
ROWS = 512

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with everything but letters made 0, row of each), the texts parted by 0."""
    low = [t.lower() if t else "" for t in texts]
    code = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    row = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    code[~is_letter(code)] = 0
    return code, row


def is_letter(code: np.ndarray) -> np.ndarray:
    """Letters by code point, as str.isalpha has it."""
    low = code < 0x250
    out = np.zeros(len(code), dtype=bool)
    out[low] = _LOW[code[low]]
    rest = np.flatnonzero(~low)
    if len(rest):
        points, back = np.unique(code[rest], return_inverse=True)
        out[rest] = np.array([chr(p).isalpha() for p in points.tolist()])[back]
    return out


_LOW = np.array([chr(i).isalpha() for i in range(0x250)])


def word_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each trigram, its word's number, row of each word) over all texts."""
    code, row = letters_of(texts)
    c = np.concatenate([[0], code, [0]]).astype(np.uint32)
    on = c > 0
    h = c[:-2] * _ODD[0] + c[1:-1] * _ODD[1] + c[2:] * _ODD[2]
    slot = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    starts = on[1:-1] & ~on[:-2]
    word = np.cumsum(starts) - 1
    keep = np.flatnonzero(on[1:-1])  # one trigram around each letter
    return slot[keep].astype(np.int64), word[keep], row[np.flatnonzero(starts)]


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x SLOTS."""
        self.languages = languages
        n = counts + SMOOTH
        self.logp = np.ascontiguousarray(np.log(n / n.sum(axis=1, keepdims=True)).T.astype(np.float32)) if languages else None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return lang, score
        slot, word, row = word_slots(texts)
        if not len(row):
            return lang, score
        like = np.add.reduceat(self.logp[slot].astype(np.float64), np.flatnonzero(np.diff(word, prepend=-1)), axis=0)  # words x languages
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        for r in range(len(texts)):
            if ends[r] < ends[r + 1]:
                k, p = mixture(like[ends[r]:ends[r + 1]])
                lang[r], score[r] = self.languages[k], p
        return lang, score


def em(like: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns and the log-likelihood; like: words x languages, each row's best is 1."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        part = like * share
        new = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        done = abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(np.log((like * share).sum(axis=1)).sum())


def mixture(loglike: np.ndarray, penalty: float = PENALTY) -> tuple[int, float]:
    """(language with the largest proportion, the proportion) of one document's words."""
    single = loglike.sum(axis=0)
    best = int(single.argmax())
    cost = penalty * np.log(len(loglike) + 1)
    top = loglike.max(axis=1, keepdims=True)
    # no mixture gains more than the words' own best languages do
    if float(top.sum()) - single[best] <= cost:
        return best, 1.0
    like = np.exp(loglike - top)
    chosen, share, value = [best], np.ones(1), float(single[best] - top.sum())
    gain = np.maximum(like - like[:, [best]], 0).sum(axis=0)  # order of trial
    for k in np.argsort(-gain).tolist():
        if k in chosen or gain[k] == 0:
            continue
        both = like[:, [*chosen, k]]
        if float(np.log(both.max(axis=1)).sum()) - value <= cost:
            continue
        new, v = em(both)
        if v - value > cost:
            chosen, share, value = [*chosen, k], new, v
    k = int(share.argmax())
    return chosen[k], float(share[k])


def fit(training: DataFrame) -> LanguageModel:
    """Learn from all rows of training(text, lang)."""
    rows = training.where("text is not null and lang is not null").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                lang, of = np.unique(np.array(part.column(1).to_pylist(), dtype=str), return_inverse=True)
                slot, word, row = word_slots(part.column(0).to_pylist())
                n = np.bincount(of[row][word] * SLOTS + slot, minlength=len(lang) * SLOTS).reshape(-1, SLOTS)
                for x, own in zip(lang.tolist(), n):
                    total[x] = total.get(x, 0) + own
        for x, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], names=["lang", "slot", "n"])

    sums = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    counts = np.zeros((len(languages), SLOTS))
    counts[np.searchsorted(languages, sums["lang"].to_numpy()) if languages else [], sums["slot"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy()
    return LanguageModel(languages, counts)


def predict(docs: DataFrame, model: LanguageModel, text: Column | str = "text") -> Column:
    """A column struct<lang, score>."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            lang, score = [], []
            for at in range(0, len(texts), ROWS):
                a, b = m.predict(texts.iloc[at:at + ROWS].tolist())
                lang += a
                score += b
            yield pd.DataFrame({"lang": lang, "score": score})

    return of(text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs.where(~held))
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), predict(docs, model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
