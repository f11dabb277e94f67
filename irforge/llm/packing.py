"""Packing by power-of-two decomposition.

A document's token ids (with an end id) are cut into pieces whose lengths are powers of two: as many
pieces of ``max_len`` as fit, then the binary digits of the rest, longest first.  Every piece is a
sequence of its own, so no sequence crosses documents and none needs padding; pieces of equal length
form a bucket, from which batches of equal shape are drawn (``write_buckets``).

Tokenizing needs no shuffle.  The tokenizer drops white space and never joins across it, so ids are
remembered per white-space-separated chunk, in flat arrays that are emptied at ``TABLE`` bytes.  Texts are
encoded about 2 MB at a time, so a worker's memory follows neither its task's rows nor their length, and
what earlier work or the last texts left free in a worker goes back to the system (``release_memory``).

Defined cases: null text is empty text, which gives one piece with the end id; a null id stays null;
repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import documents, release_memory, small_batches
from irforge.llm.token_counts import slices

MAX_LEN = 2048
END_ID = 1
#: Bytes after which a worker's table is emptied.
TABLE = 16 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """The ids of many texts, equal to encoding each whole text at once.

    Most chunks between white space are letters and closing ASCII punctuation.  Either part is one
    pre-token, whose last id alone is an end-of-word id; so many unseen parts are encoded in one
    call, parted by spaces, and cut at those ids.  All other chunks are parts that are encoded alone.
    """

    LETTERS, SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "!-/:-@\\[-`{-~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        ends = [i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends[ends] = True
        self.forget()

    def forget(self) -> None:
        """Empty the table: known parts, their ids one after the other, and where each part's begin (with the end of the last)."""
        self.known, self.ids, self.begin = pa.array([""]), np.empty(0, dtype="<u4"), np.zeros(2, dtype=np.int64)

    def table_bytes(self) -> int:
        return self.known.nbytes + self.ids.nbytes + self.begin.nbytes

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, parts: pa.Array, alone: pa.Array) -> None:
        """Put unseen parts into the table, those of ``alone`` encoded one by one."""
        apart = pc.is_in(parts, value_set=alone)
        plain, single = parts.filter(pc.invert(apart)), parts.filter(apart)
        ids, size = [self.ids], [np.diff(self.begin)]
        for i in range(0, len(plain), 2000):
            some = plain.slice(i, 2000).to_pylist()
            ids.append(self._encode(" ".join(some)))
            stop = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(stop) != len(some):
                raise ValueError("the tokenizer has no end-of-word ids")
            size.append(np.diff(stop, prepend=0))
        own = [self._encode(x) for x in single.to_pylist()]
        size.append(np.array([len(x) for x in own], dtype=np.int64))
        self.known = pa.concat_arrays([self.known, plain, single])
        self.ids = np.concatenate(ids + own)
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate(size))])

    def _places(self, parts: pa.Array, alone: pa.Array) -> np.ndarray:
        """Where each part is in the table, in which all are afterwards."""
        if self.table_bytes() > TABLE:
            self.forget()
        new = parts.filter(pc.invert(pc.is_in(parts, value_set=self.known)))
        if len(new):
            self._learn(new, alone)
        return pc.index_in(parts, value_set=self.known).to_numpy()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (with the end of the last)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        begin = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        begin = begin - begin[0]
        chunk = coded.dictionary
        plain = pc.match_substring_regex(chunk, f"^[{self.LETTERS}]*[{self.SIGNS}]*$")
        letters = pc.if_else(plain, pc.utf8_lower(pc.replace_substring_regex(chunk, f"[{self.SIGNS}]+$", "")), chunk)
        signs = pc.if_else(plain, pc.replace_substring_regex(chunk, f"^[{self.LETTERS}]+", ""), "")
        both = pa.chunked_array([letters, signs]).combine_chunks().dictionary_encode()
        place = self._places(both.dictionary, letters.filter(pc.invert(plain)))
        first, size = self.begin[place], np.diff(self.begin)[place]
        # the parts of every word in order: its letters, then its signs
        halves = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
        index = halves[:, coded.indices.to_numpy(zero_copy_only=False)].T.ravel()
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        some = np.flatnonzero(n)
        index, n, at = index[some], n[some], ends[:-1][some]
        # places fit in 32 bits: a text's bytes do, and the table is smaller
        place = np.repeat((first[index] - at).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return self.ids[place], ends[2 * begin]


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer is kept by a Python worker from task to task; its table is emptied after each."""
    return ChunkTokenizer(path)


def binary_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Powers of two that add up to ``n``, none above ``max_len``, longest first."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens,
    bucket (log2 of the length), sequence_id, offset."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = path or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        tok = worker_tokenizer(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, 1):
                row, start, length, ids, total = [], [], [], [], []
                flat, begin = tok(part.column(1))
                raw, begin = flat.tobytes(), (begin * 4).tolist()
                for r in range(part.num_rows):
                    b = raw[begin[r]:begin[r + 1]] + end
                    place = 0
                    for n in binary_lengths(len(b) // 4, max_len):
                        row.append(r)
                        start.append(place)
                        length.append(n)
                        ids.append(b[4 * place:4 * (place + n)])
                        place += n
                    total += [place] * (len(row) - len(total))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"])
                release_memory()
        tok.forget()
        release_memory()

    pieces = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, from which batches of equal shape can be read."""
    pieces.write.partitionBy("bucket").parquet(path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(documents(spark, sf_dir))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
