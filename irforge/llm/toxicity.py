"""Toxicity scores behind a noisy-channel decoder.

* Decoder: a token of letters and look-alike signs, with letters repeated, or spelt out with gaps is a
  lattice: every sign may stand for the letters it looks like, a run of one letter for one or two of
  it, and among spaced letters a word may end after each.  Viterbi search finds the likeliest word under a character trigram model times the channel's
  costs.  The model counts every document of the input.
* Scores: features are the restored text's words and their first four to six letters, at levels of
  how often (1, 2, 4, 8 times) and how densely (0.25 to 4 in a hundred tokens) they occur.  Features
  that a likelihood-ratio test links to the label become the lexicon, and a logistic regression
  (MLlib) over them and the strongest one's log-odds gives the score.

Labels come from a bounded sample of at most ``TRAIN_ROWS`` labelled rows in hash order, of which one
per group of near copies counts (equal least 3-word shingle hash), so that a copied document does not
teach its names.  The lexicon is cut at ``LEXICON`` features.  Scoring needs no shuffle.

Defined cases: null and empty texts have no features and get the regression's base score; without labels
of both kinds every score is 0; rows with a null label or id teach nothing; repeated rows are scored
alike; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import WORD_TABLE, crc_mod, documents, small_batches
from irforge.session import materialize

TRAIN_ROWS = 24_000
LEXICON = 8_000
MIN_G = 8.0
THRESHOLD = 0.7
ROWS = 1024
#: Training rows that one task counts at a time; its table of features is in memory.
TASK_ROWS = 500
#: Characters of a feature, and of a token that the decoder remembers.
LONGEST = 24

# The letters that signs are used for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c"}
#: Log costs of the channel: a letter as itself, a sign for a letter, a run for another number of letters.
AS_IS, SIGN, RUN = math.log(0.95), math.log(0.2), math.log(0.1)

_WORD = re.compile(r"[^\W\d_]+")
_SPELT = re.compile(r"(?:[^\W_][.\-_*]+){2,}[^\W_]")
_GAP = re.compile(r"[.\-_*]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_RUN_RE2 = "|".join(c * 3 for c in map(chr, range(97, 123))) + "|" + "|".join(c * 3 for c in map(chr, range(0xDF, 0x180)) if c.isalpha())
_RUNS = re.compile(r"(.)\1*", re.S)
_LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
COUNT_LEVELS = (1, 2, 4, 8)
RATE_LEVELS = (0.25, 0.5, 1, 2, 4)
#: A document's largest bound is a feature too, so that one strong word counts as much as several.
STEPS = {f"=most{x}": x for x in (1, 2, 3, 4, 5, 6)}
_OPEN, _CLOSE = "([{<", ")]}>"
_EDGE = ".,;:?'\"-*#%&~`)]}>_"

# Classes of the character model: 0 end of a word, 1-26 a-z, 27 any other letter.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[192:] = 27
_SIZE = 28


def char_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of class trigrams over the letters of the texts, words ended by class 0."""
    b = np.frombuffer((" ".join([t for t in texts if t]).lower() + "  ").encode("utf-8", "replace"), dtype=np.uint8)
    c = _CLASS[b[(b < 128) | (b >= 192)]]  # later bytes of a letter go
    return np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE ** 3) if len(c) > 2 else np.zeros(_SIZE ** 3, dtype=np.int64)


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(class | two classes before), from all documents; 28 ** 3 counts reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE ** 3, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                total += trigram_counts(b.column(0).slice(at, ROWS).to_pylist())
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n = np.full(_SIZE ** 3, 0.5)
    n[rows["k"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
    n = n.reshape(_SIZE, _SIZE, _SIZE)
    return np.log(n / n.sum(axis=2, keepdims=True))


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one sign, the strings it may stand for and their costs; ``spaced``: a word may end
    after or within it."""
    out = []
    for m in _RUNS.finditer(token):
        c, n = m.group(1), len(m.group(0))
        letters = [(x, SIGN) for x in LOOKS_LIKE[c]] if c in LOOKS_LIKE else [(c, AS_IS)]
        options = [(x * k, cost * min(n, k) + (0 if k == n else RUN)) for x, cost in letters for k in {min(n, 2), 1}]
        if spaced:
            options += [(s + " ", cost) for s, cost in options]
            if n > 1:
                options += [(x + " " + x, cost * 2 + (0 if n == 2 else RUN)) for x, cost in letters]
        out.append(options)
    return out


def decode(token: str, logp: np.ndarray, spaced: bool = False) -> str:
    """The likeliest word (``spaced``: words) behind a token (Viterbi over the last two classes)."""
    paths: dict[tuple, tuple] = {(0, 0): (0.0, None)}
    for options in [*lattice(token, spaced), [("", 0.0)]]:
        new: dict[tuple, tuple] = {}
        for (a, b), (score, word) in paths.items():
            for s, cost in options:
                x, y, p = a, b, score + cost
                for z in map(char_class, s) if s else (0,):
                    p += logp[x, y, z]
                    x, y = y, z
                if (x, y) not in new or p > new[x, y][0]:
                    new[x, y] = (p, (word, s))  # linked, so that a long token costs no more per sign
        paths = new
    best = max(p for p, _ in paths.values())
    return max(_spelling(word) for p, word in paths.values() if p == best)


def _spelling(word: tuple | None) -> str:
    out = []
    while word is not None:
        word, s = word
        out.append(s)
    return "".join(reversed(out))


class Decoder:
    """The words behind a token, disguised ones restored."""

    def __init__(self, logp: np.ndarray):
        self.logp, self.known = logp, {}

    def _restored(self, token: str, spaced: bool = False) -> str:
        token = _LONG_RUN.sub(r"\1\1\1", token)  # longer runs have the same lattice
        if len(token) > LONGEST:
            return decode(token, self.logp, spaced)
        if (token, spaced) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token, spaced] = decode(token, self.logp, spaced)
        return self.known[token, spaced]

    def words(self, token: str) -> list[str]:
        """token: lower case, without white space."""
        if token.isalpha():
            return [token, self._restored(token)] if _RUN.search(token) else [token]
        whole, token = token, token.strip(_EDGE)
        if token.isalpha():
            return [token, self._restored(token)] if _RUN.search(token) else [token]
        out = _WORD.findall(token)
        if out:
            bare = token.lstrip(_OPEN)
            if bare != token and any(c in _CLOSE for c in whole[whole.rindex(token) + len(token):]):
                token = bare  # a closed bracket is no letter
            restored = set()
            for core in {token, bare, token.rstrip("!$"), bare.rstrip("!$").rstrip(_EDGE)}:
                if core.isalpha():
                    if _RUN.search(core):
                        restored.add(self._restored(core))
                elif _SPELT.fullmatch(core):
                    restored.add(self._restored(_GAP.sub("", core)))
                elif core and not token.rstrip("!$").isalpha() and all(c in LOOKS_LIKE or c.isalpha() for c in core):
                    restored.add(self._restored(core))
            out += sorted(restored)
        return out

    def joined(self, letters: list[str]) -> list[str]:
        """The word or words spelt by three or more single letters or signs in a row, if it is one."""
        word = "".join(letters)
        if 3 <= len(word) and not word.isdigit() and all(c in LOOKS_LIKE or c.isalpha() for c in word):
            one = self._restored(word)
            return [one, *(w for w in self._restored(word, True).split() if w != one)]
        return []


class Tokens:
    """The lower-case tokens of many texts, each distinct one once."""

    def __init__(self, texts: list[str | None]):
        words = pc.ascii_split_whitespace(pa.array([t.lower() if t else "" for t in texts], pa.string()))
        coded = words.values.dictionary_encode()
        self.distinct, self.at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.begin = words.offsets.to_numpy()
        size = pc.utf8_length(self.distinct).to_numpy(zero_copy_only=False)[self.at]
        self.n = np.diff(np.concatenate([[0], np.cumsum(size > 0)])[self.begin])
        single = np.flatnonzero(size == 1)
        row = np.searchsorted(self.begin, single, "right") - 1
        new = np.flatnonzero((np.diff(single, prepend=-9) != 1) | (np.diff(row, prepend=-9) != 0))
        end = np.append(new[1:], len(single))
        #: (row, places) of three or more single letters in a row.
        self.spelt = [(int(row[a]), single[a:b]) for a, b in zip(new, end) if b - a >= 3]

    def letters(self, places: np.ndarray) -> list[str]:
        return self.distinct.take(pa.array(self.at[places])).to_pylist()


def names(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [word[:LONGEST]] + [word[:n] + "~" for n in (4, 5, 6) if len(word) > n]


def levels(counts: dict[str, int], n: int) -> list[str]:
    """The features with the levels their counts reach in a text of n tokens."""
    marks, out = {}, []
    for f, c in counts.items():
        m = marks.get(c)
        if m is None:
            m = marks[c] = [f"#{x}" for x in COUNT_LEVELS if c >= x] + [f"%{x}" for x in RATE_LEVELS if 100 * c >= x * n]
        out += [f + x for x in m]
    return out


def all_levels(tokens: Tokens, decoder: Decoder) -> Iterator[list[str]]:
    """All features' levels of each text."""
    of = [decoder.words(t) for t in tokens.distinct.to_pylist()]
    extra = defaultdict(list)
    for r, places in tokens.spelt:
        extra[r] += decoder.joined(tokens.letters(places))
    for r, (a, b) in enumerate(zip(tokens.begin[:-1], tokens.begin[1:])):
        counts: dict[str, int] = {}
        for i, c in Counter(tokens.at[a:b].tolist()).items():
            for w in of[i]:
                for f in names(w):
                    counts[f] = counts.get(f, 0) + c
        for w in extra[r]:
            for f in names(w):
                counts[f] = counts.get(f, 0) + 1
        yield levels(counts, int(tokens.n[r]))


class ToxicityModel:
    """Bounds (least log-odds) of the lexicon's feature levels; weights of these and of the steps of the
    largest bound; the base weight, None if nothing was learned."""

    def __init__(self, logp: np.ndarray, bounds: dict[str, float], weights: dict[str, float], base: float | None):
        self.logp, self.bounds, self.weights, self.base = logp, bounds, weights, base
        self.wanted = {re.split("[#%]", f)[0] for f in bounds}
        self.of: dict[str, list[str]] = {}
        self.heads = pa.array(sorted({f.rstrip("~")[:4] for f in self.wanted}), pa.string())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"of": {}}

    def _wanted_of(self, words: list[str]) -> list[str]:
        return [f for w in words for f in names(w) if f in self.wanted]

    def found(self, texts: list[str | None], decoder: Decoder) -> list[list[str]]:
        """The levels of the lexicon's features in each text, and the steps."""
        tokens, of = Tokens(texts), self.of
        if len(of) > WORD_TABLE:
            of.clear()
        # only tokens that begin like a feature, or that the decoder may change, need a look
        core = pc.utf8_trim(tokens.distinct, _EDGE)
        look = pc.or_(pc.is_in(pc.utf8_slice_codeunits(core, 0, 4), value_set=self.heads), pc.or_(pc.invert(pc.utf8_is_alpha(core)), pc.match_substring_regex(core, _RUN_RE2)))
        features: dict[int, list[str]] = {}
        for i in np.flatnonzero(look.to_numpy(zero_copy_only=False)).tolist():
            t = tokens.distinct[i].as_py()
            f = of.get(t)
            if f is None:
                f = of[t] = self._wanted_of(decoder.words(t))
            if f:
                features[i] = f
        some = np.zeros(len(tokens.distinct), dtype=bool)
        some[list(features)] = True
        hits = np.flatnonzero(some[tokens.at])
        counts: list[dict[str, int]] = [{} for _ in texts]
        for r, i in zip((np.searchsorted(tokens.begin, hits, "right") - 1).tolist(), tokens.at[hits].tolist()):
            for x in features[i]:
                counts[r][x] = counts[r].get(x, 0) + 1
        for r, places in tokens.spelt:
            for x in self._wanted_of(decoder.joined(tokens.letters(places))):
                counts[r][x] = counts[r].get(x, 0) + 1
        out = []
        for c, n in zip(counts, tokens.n.tolist()):
            own = [x for x in levels(c, n) if x in self.bounds]
            most = max((self.bounds[x] for x in own), default=0)
            out.append(own + [x for x in STEPS if most >= STEPS[x]])
        return out

    def scores(self, texts: list[str | None], decoder: Decoder) -> list[float]:
        if self.base is None:
            return [0.0] * len(texts)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, self.base + sum(self.weights[f] for f in own))))) for own in self.found(texts, decoder)]


def _group(text: str) -> int:
    """Equal for copies, and for most near copies."""
    w = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from ``docs`` (all of them for the character model) and labels(doc_id, toxic)."""
    small_batches(docs.sparkSession)
    logp = char_model(docs)
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("y")) \
        .orderBy(F.xxhash64("d"), "d", "y").limit(train_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("d")).select("text", "y")

    @F.pandas_udf("long")
    def group(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _group(t or ""))

    one = materialize(train.groupBy(group("text").alias("g"), "y").agg(F.min("text").alias("text")).select("text", "y").repartition(max(1, train_rows // TASK_ROWS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec, n = Decoder(logp), defaultdict(lambda: [0, 0])
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for own, y in zip(all_levels(Tokens(part.column(0).to_pylist()), dec), part.column(1).to_pylist()):
                    for f in own:
                        n[f][y > 0] += 1
                    n[""][y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], names=["f", "clean", "toxic"])

    counts = materialize(one.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("f = '' or toxic >= 3"))
    clean, toxic = next(iter([(r.clean, r.toxic) for r in counts.where("f = ''").collect()]), (0, 0))
    if not clean or not toxic:
        return ToxicityModel(logp, {}, {}, None)
    top = counts.where("f != ''").withColumn("g", likelihood_ratio(F.col("toxic"), toxic, F.col("clean"), clean)).where(F.col("g") >= MIN_G).orderBy(F.desc("g"), "f").limit(LEXICON).collect()
    bounds = {r.f: least_log_odds(r.toxic, toxic, r.clean, clean) for r in top}
    lexicon = ToxicityModel(logp, bounds, {}, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(logp)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(lexicon.found(part.column(0).to_pylist(), dec), pa.list_(pa.string())), pa.array([float(y > 0) for y in part.column(1).to_pylist()])], names=["f", "label"])

    vocabulary = [*bounds, *STEPS]
    slots = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="f", outputCol="features")
    data = materialize(slots.transform(one.mapInArrow(rows, "f array<string>, label double")).select("features", "label"))
    fitted = LogisticRegression(maxIter=100, regParam=1e-4, elasticNetParam=0.0, standardization=False).fit(data)
    weights = fitted.coefficients.toArray()
    return ToxicityModel(logp, bounds, dict(zip(vocabulary, weights.tolist())), float(fitted.intercept))


def least_log_odds(a: int, n: int, b: int, m: int) -> float:
    """Lower end of the 90 % interval of the smoothed log-odds of a in n against b in m."""
    return math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1)) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def likelihood_ratio(a: Column, n: int, b: Column, m: int) -> Column:
    """G statistic of a in n against b in m; 0 where the first share is not the larger one."""
    def part(k: Column, size: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < size, (size - k) * F.log(1 - p)).otherwise(0.0)

    both = (a + b) / float(n + m)
    return F.when(a / float(n) > b / float(m), 2 * (part(a, n, a / float(n)) + part(b, m, b / float(m)) - part(a, n, both) - part(b, m, both))).otherwise(0.0)


def scorer(docs: DataFrame, model: ToxicityModel):
    """A column function text -> score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        dec = Decoder(m.logp)
        for texts in batches:
            yield pd.Series([x for at in range(0, len(texts), ROWS) for x in m.scores(texts.iloc[at:at + ROWS].tolist(), dec)], dtype=float)
            pa.default_memory_pool().release_unused()

    return lambda text: score(text)


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_mod("doc_id", 3) == 1
    score = scorer(docs, fit(docs, labels.where(~held)))
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", predicted(F.col("score")))
