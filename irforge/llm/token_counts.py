"""Token counts: pieces are counted once for every distinct pre-token of the corpus.

A byte-level BPE merges within pre-tokens only, so a text has as many tokens as its pre-tokens have together.

1. Vocabulary: every text is cut into pre-tokens; distinct ones with their frequency go through one aggregation, and
   the pieces of each are counted once.  Ids exist for the moment of that count only.
2. Documents: each text's pre-token frequencies meet the counts.  The most frequent pre-tokens, at most
   ``FREQUENT``, are broadcast as digests of 16 bytes; their part of the sum needs no shuffle.
   All others are exploded and joined by digest.  None of them can be a hot key: over ``FREQUENT`` others are about as frequent or
   more so, which leaves each at most 1.1 / FREQUENT of all occurrences.

A special token's string in a text is one pre-token, as the library treats it by default.

Defined cases: null text is empty text, with no bytes and no tokens; a null id stays null; repeated rows
are counted each; an empty table gives an empty result; any further columns are left aside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import documents, small_batches
from irforge.session import materialize

LIMIT = 1024
#: Most pre-tokens of the broadcast table (24 bytes each).
FREQUENT = 1 << 19
#: Frequencies are told apart by bins, so many to each doubling.
BINS = 8
#: Bytes of the texts that are cut together.
BYTES = 1 << 21


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Cutter:
    """The pre-tokens of many texts, cut together.

    The tokenizer's pre-tokens are runs of letters, of digits, of white space or of other signs, each with one
    space before it; white space before a run keeps all but its last character to itself, and a short list of
    endings after an apostrophe stand alone.  A character's class is asked of the tokenizer's own pre-tokenizer when it is
    first seen, so its tables hold.  A text with the string of a special token is cut by the library.
    """

    #: The endings that the pre-tokenizer cuts off after an apostrophe.
    ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
    LETTER, DIGIT, SIGN, WHITE, UNSEEN = range(5)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        kind = json.loads(self.tok.to_str())
        added = list(self.tok.get_added_tokens_decoder().values())
        cutter = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or any(a.lstrip or a.rstrip or a.single_word for a in added) \
                or (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError("the tokenizer does not cut texts as byte-level BPE does")
        special = "|".join(re.escape(a.content) for a in sorted(added, key=lambda a: -len(a.content)))
        self.special = re.compile(f"({special})") if special else None
        self.classes = np.full(0x110000, self.UNSEEN, dtype=np.uint8)

    def _class(self, code: int) -> int:
        c = chr(code)
        size = [b - a for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(f"a{c}{c}{c}1")]
        return {(4, 1): self.LETTER, (1, 4): self.DIGIT, (1, 3, 1): self.SIGN}.get(tuple(size), self.WHITE)

    def cut(self, text: str) -> list[str]:
        """The library's own pre-tokens of a text, with the special strings in it."""
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a pre-token; code: all texts' characters, first: which of them begin a text."""
        k = self.classes[code]
        if (k == self.UNSEEN).any():
            for c in np.unique(code[k == self.UNSEEN]).tolist():
                self.classes[c] = self._class(c)
            k = self.classes[code]
        start = np.concatenate([k[:1] == k[:1], k[1:] != k[:-1]]) | first
        white = k == self.WHITE
        # the last of a run of white space that something follows
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
        start[last] = True
        start[last + 1] = code[last] != 32
        at = np.flatnonzero((code == 39) & start)
        code, first = np.append(code, [0, 0, 0]), np.append(first, [True, True, True])
        for end in self.ENDINGS:
            hit = at[np.logical_and.reduce([(code[at + i + 1] == ord(c)) & ~first[at + i + 1] for i, c in enumerate(end)])]
            start[hit + 1] = False
            after = hit + len(end) + 1
            start[after[after < len(start)]] = True
        return start

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct pre-tokens, index of each occurrence, its text)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = np.zeros(len(texts), dtype=bool)
        if self.special:
            apart = pc.match_substring_regex(texts, self.special.pattern).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(apart), "", texts)
        offsets = np.frombuffer(plain.buffers()[1], dtype=np.int32)[plain.offset:plain.offset + len(plain) + 1].astype(np.int64)
        data = np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
        place = np.flatnonzero((data & 0xC0) != 0x80)
        begin = np.searchsorted(place, offsets - offsets[0])
        first = np.zeros(len(place), dtype=bool)
        first[begin[:-1][begin[:-1] < begin[1:]]] = True
        start = np.flatnonzero(self.starts(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4"), first)) if len(place) else np.empty(0, dtype=np.int64)
        stops = np.append(place[start], len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(data)))
        row = np.searchsorted(begin[:-1], start, side="right") - 1
        for i in np.flatnonzero(apart).tolist():
            own = pa.array(self.cut(texts[i].as_py()), pa.string())
            words, row = pa.concat_arrays([words, own]), np.append(row, np.full(len(own), i))
        coded = words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``BYTES`` of text each, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


@lru_cache(maxsize=1)
def worker_cutter(path: str) -> Cutter:
    """Kept by a Python worker from task to task."""
    return Cutter(path)


def _digests(pretokens: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.encode()) for p in pretokens), dtype="S16")


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(h, n, f): digest, pieces and frequency of every distinct pre-token, written."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = worker_cutter(path)
        for b in batches:
            for part in slices(b, 0):
                words, index, _ = cutter(part.column(0))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(index, minlength=len(words)), pa.int64())], names=["p", "f"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_cutter(path).tok
        for b in batches:
            words = b.column(0).to_pylist()
            n = [len(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
            digest = [xxhash.xxh3_128_digest(w.encode()) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(n, pa.int64()), b.column(1)], names=["h", "n", "f"])

    distinct = docs.select("text").mapInArrow(frequencies, "p string, f long").groupBy("p").agg(F.sum("f").alias("f"))
    return materialize(distinct.mapInArrow(pieces, "h binary, n long, f long"))


def frequent_counts(vocab: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted digests, their pieces, least frequency) of the at most ``most`` pre-tokens that are found most often."""
    bins = vocab.groupBy(F.floor(F.log2("f") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("least")).collect()
    room, least = most, 1 << 62
    for r in sorted(bins, key=lambda r: -r.bin):
        room -= r.n
        if room < 0:
            break
        least = r.least
    rows = vocab.where(F.col("f") >= least).select("h", "n").toArrow()
    h = np.array(rows["h"].to_pylist(), dtype="S16")
    order = np.argsort(h, kind="stable")
    return h[order], rows["n"].to_numpy()[order].astype(np.int64), least


def partial_counts(docs: DataFrame, path: str, known: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """(row, doc_id, n_bytes, n, rest array<struct<h, f>>): the tokens of frequent pre-tokens, and the others' frequencies; written."""
    sent = docs.sparkSession.sparkContext.broadcast((known, pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = worker_cutter(path)
        known, pieces = sent.value
        for b in batches:
            for part in slices(b, 1):
                words, index, row = cutter(part.column(1))
                digest = _digests(words.to_pylist())
                place = np.minimum(np.searchsorted(known, digest), max(len(known) - 1, 0))
                found = known[place] == digest if len(known) else np.zeros(len(digest), dtype=bool)
                own = np.where(found, pieces[place], 0) if len(known) else np.zeros(len(digest), dtype=np.int64)
                n = np.bincount(row, weights=own[index], minlength=part.num_rows).astype(np.int64)
                # frequencies of the rest, by text
                other = ~found[index]
                pair, f = np.unique(row[other] * max(len(words), 1) + index[other], return_counts=True)
                width = np.bincount(pair // max(len(words), 1), minlength=part.num_rows)
                h = pa.array([digest[i].ljust(16, b"\0") for i in (pair % max(len(words), 1)).tolist()], pa.binary())
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.StructArray.from_arrays([h, pa.array(f, pa.int32())], ["h", "f"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), rest], names=["doc_id", "n_bytes", "n", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")) \
        .mapInArrow(count, f"doc_id {kind}, n_bytes long, n long, rest array<struct<h: binary, f: int>>")
    out = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    sent.destroy()
    return out


def token_counts(docs: DataFrame, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs(doc_id, text)."""
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    vocab = vocabulary(docs, path)
    known, pieces, least = frequent_counts(vocab, frequent)
    rows = partial_counts(docs, path, known, pieces)
    rare = rows.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.f").join(vocab.where(F.col("f") < least).select("h", F.col("n").alias("pieces")), "h")
    both = rows.select("row", "doc_id", "n_bytes", "n").unionByName(rare.select("row", (F.col("f") * F.col("pieces")).alias("n")), allowMissingColumns=True)
    return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("row")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
