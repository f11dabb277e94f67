"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts are read as words (lower case, ASCII punctuation is a blank).  A document leaks an item of n
words if some stretch of it is within ``max_edits * n`` word edits of the item.

* CGK embedding: a random walk copies the current word and moves on with a coin that depends on the
  step and the word, for 3n steps; words within few edits get embeddings within small Hamming
  distance, because two walks that part at an edit meet again soon.
* Bit sampling: a signature is the embedding at ``SAMPLED`` random steps.  Items and windows with the
  same length, repetition and signature are candidates; ``EMBEDDINGS * SAMPLINGS`` repetitions give
  the target recall (measured in the tests).
* Candidates are verified by a banded edit distance between the item and what begins at the window,
  so there are no false reports.

Windows that cannot match are not embedded: t edits leave an untouched run of at least
ceil((n - t) / (t + 1)) words, and an edit spoils at most g of the n - g + 1 runs of g words, so a
document must share n - g + 1 - g * t of the item's runs (g: that length, three at most; one run at
least), and windows begin within t words of where a shared run puts them.  This loses nothing.

Items are sent to all workers in slices of at most ``ITEM_BYTES``; a larger benchmark takes one pass
over the documents for each slice.  Documents are never shuffled.

Defined cases: null or empty texts and items match nothing; an item repeated in the benchmark is
reported under each of its ids; a null document id is reported as null; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from irforge.llm.base import BYTE_FACTORS, documents, mix, word_hashes

MAX_EDITS = 0.2
SAMPLED = 2
EMBEDDINGS = 12
SAMPLINGS = 20
ITEM_BYTES = 8 << 20
SEED = 7
ROWS = 256
BITS = 22

#: ASCII signs other than letters and digits part words, as white space does.
_FACTORS = np.where([chr(i).isascii() and not chr(i).isalnum() and i >= 32 for i in range(256)], np.uint64(0), BYTE_FACTORS)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text), in lower case."""
    if not texts:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return word_hashes(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), "")), _FACTORS)


def edits_to_start(item: list, words: list, limit: int) -> int:
    """Fewest word edits between the item and a beginning of ``words``, or limit + 1 if there are more."""
    far = limit + 1
    row = {j: j for j in range(min(len(words), limit) + 1)}
    for i, x in enumerate(item, 1):
        new = {}
        for j in range(max(0, i - limit), min(len(words), i + limit) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != words[j - 1]))
        row = new
        if min(row.values(), default=far) > limit:
            return far
    return min(min(row.values()), far)


class Matcher:
    """The items' signatures and run index, and the search of texts against them."""

    def __init__(self, items: list[tuple[object, str | None]], max_edits: float = MAX_EDITS, seed: int = SEED):
        self.rng, self.max_edits = np.random.default_rng(seed), max_edits
        w, size = hashed_words([t for _, t in items])
        words = [(i, own) for (i, _), own in zip(items, np.split(w, np.cumsum(size)[:-1])) if len(own)]
        self.ids, self.items = [i for i, _ in words], [w for _, w in words]
        self.limit = [int(max_edits * len(w)) for w in self.items]
        self.plans = {n: self._plan(n) for n in {len(w) for w in self.items}}
        self.tables: dict[int, list[dict]] = {}
        for n in self.plans:
            own = [k for k, w in enumerate(self.items) if len(w) == n]
            sigs = self._signatures(np.concatenate([self.items[k] for k in own]), at := np.arange(len(own)) * n, at + n, n)
            self.tables[n] = [defaultdict(list) for _ in sigs]
            for table, sig in zip(self.tables[n], sigs):
                for k, s in zip(own, sig.tolist()):
                    table[s].append(k)
        runs: dict[int, list] = defaultdict(list)
        self.shared = []  # an edit spoils at most g of an item's n - g + 1 runs
        for k, w in enumerate(self.items):
            g = min(3, -(-(len(w) - self.limit[k]) // (self.limit[k] + 1)))
            self.shared.append(max(1, len(w) - g + 1 - g * self.limit[k]))
            runs[g] += [(h, k, p) for p, h in enumerate(self._runs(w, g).tolist())]
        self.runs = {}
        for g, rows in runs.items():
            rows.sort()
            key = np.array([r[0] for r in rows], dtype=np.uint64)
            seen = np.zeros(1 << BITS, dtype=bool)
            seen[(key >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.runs[g] = (seen, key, [r[1:] for r in rows])

    @staticmethod
    def _runs(w: np.ndarray, g: int) -> np.ndarray:
        if len(w) < g:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(len(w) - g + 1, dtype=np.uint64)
        for j in range(g):
            out += w[j:len(w) - g + 1 + j] * _ODD[j]
        return mix(out)

    def _plan(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Coins' factors by embedding and step, and the sampled steps by embedding and sampling."""
        rng = np.random.default_rng([self.rng.bit_generator.seed_seq.entropy, n])
        steps = 3 * n
        return (rng.integers(0, 2**63, (EMBEDDINGS, steps)).astype(np.uint64) * np.uint64(2) + np.uint64(1),
                rng.integers(0, steps, (EMBEDDINGS, SAMPLINGS, SAMPLED)))

    def _signatures(self, w: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
        """One array for each repetition: the signatures of the windows w[start:start + n], cut off at ends."""
        coins, sampled = self.plans[n]
        out = []
        size = np.minimum(n, ends - starts)
        last = len(w) - 1
        for e in range(EMBEDDINGS):
            at = np.zeros(len(starts), dtype=np.int64)
            kept = {}
            need = set(sampled[e].ravel().tolist())
            for j in range(max(need) + 1):
                word = np.where(at < size, w[np.minimum(starts + at, last)], np.uint64(0))
                if j in need:
                    kept[j] = word
                at += ((word * coins[e, j]) >> np.uint64(63)).astype(np.int64)
            for s in range(SAMPLINGS):
                sig = np.zeros(len(starts), dtype=np.uint64)
                for j in sampled[e, s].tolist():
                    sig = mix(sig * np.uint64(31) + kept[j])
                out.append(sig)
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item, first word of the window, edits): the best window of every leaked item."""
        w, size = hashed_words(texts)
        if not self.items or not len(w):
            return []
        ends = np.cumsum(size)
        windows: dict[int, set] = defaultdict(set)  # by length: (first word, row)
        near: dict[tuple, set] = defaultdict(set)  # (row, item): the item's words where shared runs begin, implied first words
        for g, (seen, key, rows) in self.runs.items():
            h = self._runs(w, g)
            hits = np.flatnonzero(seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            lo = np.searchsorted(key, h[hits], "left")
            hi = np.searchsorted(key, h[hits], "right")
            of = np.searchsorted(ends, hits, "right")
            real = np.flatnonzero((hi > lo) & (hits + g <= ends[of]))
            for p, r, a, b in zip(hits[real].tolist(), of[real].tolist(), lo[real].tolist(), hi[real].tolist()):
                for k, q in rows[a:b]:
                    near[r, k].add((q, p - q))
        near = {x: Counter(s for _, s in at) for x, at in near.items() if len({q for q, _ in at}) >= self.shared[x[1]]}
        for (r, k), starts in near.items():
            first, n, t = int(ends[r] - size[r]), len(self.items[k]), self.limit[k]
            for s in {s + d for s in starts for d in range(-t, t + 1)}:
                # a window over the end of its document is as long as what is there
                if s >= first and s + n - t <= ends[r]:
                    windows[n].add((s, r))
        found: dict[tuple, set] = defaultdict(set)
        for n, at in windows.items():
            at = sorted(at)
            starts = np.array([s for s, _ in at], dtype=np.int64)
            stops = ends[[r for _, r in at]]
            for table, sig in zip(self.tables[n], self._signatures(w, starts, stops, n)):
                for i, x in enumerate(sig.tolist()):
                    for k in table.get(x, ()):
                        if (at[i][1], k) in near:
                            found[at[i][1], k].add(at[i][0])
        out = []
        for (r, k), starts in found.items():
            item, best, limit = self.items[k].tolist(), None, self.limit[k]
            for s in sorted(starts, key=lambda s: (-near[r, k][s], s)):
                e = edits_to_start(item, w[s:min(s + len(item) + limit, ends[r])].tolist(), limit)
                if e <= limit:
                    best, limit = (e, s), e - 1
                if limit < 0:
                    break
            if best:
                out.append((r, k, int(best[1] - ends[r] + size[r]), best[0]))
        return out


def item_slices(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's (id, text) in slices of about ``limit`` bytes at most."""
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()]


def leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, start_word, n_words, edits."""
    d, i = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {d}, item_id {i}, start_word long, n_words long, edits long"
    out = None
    for part in item_slices(items):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = Matcher(sent.value, max_edits)
            ids = pa.array(m.ids, item_type)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(at, ROWS)
                    got = np.array(m.search(rows.column(1).to_pylist()), dtype=np.int64).reshape(-1, 4)
                    size = np.array([len(m.items[k]) for k in got[:, 1]], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(got[:, 0])), ids.take(pa.array(got[:, 1])), pa.array(got[:, 2]), pa.array(size), pa.array(got[:, 3])],
                                                     names=["doc_id", "item_id", "start_word", "n_words", "edits"])

        one = docs.select("doc_id", "text").mapInArrow(find, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _clean(sent, max_edits: float):
    """A column function text -> whether it leaks none of the broadcast items."""
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(sent.value, max_edits)
        for texts in batches:
            ok = np.ones(len(texts), dtype=bool)
            for at in range(0, len(texts), ROWS):
                for g in m.search(texts.iloc[at:at + ROWS].tolist()):
                    ok[at + g[0]] = False
            yield pd.Series(ok)

    return clean


def drop_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    for part in item_slices(items):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(part), max_edits)("text"))
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
