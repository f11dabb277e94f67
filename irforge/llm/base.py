"""Small helpers the corpus operators share: the input table, row keys, word hashing."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Entries after which a worker forgets its word table (bounds the memory of a Python worker).
WORD_TABLE = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Bound a Python worker's memory by smaller Arrow batches (the session's limit, if it is lower, holds)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Give back to the system what a Python worker holds but does not use: Arrow's pool and, if the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fitted(df: DataFrame, rows: int, per: int = 100_000) -> DataFrame:
    """``df`` in no more partitions than one for every ``per`` of its ``rows`` (counted, not guessed)."""
    return df.coalesce(max(1, -(-rows // per)))


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null id: null)."""
    return (F.crc32(F.col(col).cast("string").cast("binary")) % m).cast("int")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII strings take the fast JVM path; others are translated."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, up, up.lower()))


class WordHash:
    """Word (bytes) -> uint64, remembered per worker up to ``WORD_TABLE`` entries."""

    def __init__(self, seed: int = 0):
        self.seed, self.table = seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        t, seed, h = self.table, self.seed, xxhash.xxh3_64_intdigest
        if len(t) > WORD_TABLE:
            t.clear()
        out = [t.get(w) for w in words]
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    v = t.get(w)
                    if v is None:
                        v = t[w] = h(w, seed)
                    out[i] = v
        return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the order of the values says nothing about the words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd factor for every byte, 0 for ASCII white space.
BYTE_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_FACTORS[65:91] = BYTE_FACTORS[97:123]  # A-Z as a-z
BYTE_FACTORS[[ord(c) for c in BLANKS]] = 0
_PLACE = 0xD6E8FEB86659FD93


def word_hashes(texts: pa.Array, factors: np.ndarray = BYTE_FACTORS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words of each text): words are runs of bytes whose factor is not 0; by default, bytes
    other than ASCII white space, A-Z read as a-z.  A hash is the sum of a random factor for each byte times one for its
    place, so all words of a batch are hashed together."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    begin = offsets - offsets[0]
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    value = factors[data]
    inside = value > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = begin[:-1][begin[:-1] < len(data)]
    first[edge] = inside[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    size = np.diff(np.append(at, len(data)))
    value = value[at[0]:]
    value *= np.cumprod(np.full(int(size.max()), _PLACE, dtype=np.uint64))[np.arange(len(value)) - np.repeat(at - at[0], size)]
    words = mix(np.add.reduceat(value, at - at[0]))
    return words, np.diff(np.searchsorted(at, begin))


#: log2 of the bits of a broadcast bitmap (16 MB).
BITMAP = 27
#: log2 of the 64-bit words of a page, in which a bitmap comes to the driver.
PAGE = 12
#: Pages of a task's result: 256 KB at most, so that the driver gets a bitmap in small pieces, not in one or two large ones.
TASK_PAGES = 8


class _Pages:
    """Packed pages of a bitmap as the driver holds and sends them; they are unpickled as the bitmap's 64-bit words."""

    def __init__(self, size: int, pages: list[tuple[int, bytes]]):
        self.size, self.pages = size, pages

    def __reduce__(self):
        return _unpacked, (self.size, self.pages)


def _unpacked(size: int, pages: list[tuple[int, bytes]]) -> np.ndarray:
    out = np.zeros(size, dtype=np.uint64)
    for page, raw in pages:
        out[page << PAGE:(page + 1) << PAGE] = np.frombuffer(zlib.decompress(raw), dtype=np.uint64)
    return out


class Bitmap:
    """A fixed-size set of 64-bit hashes for use inside Python workers: no false negatives, some false
    positives.  Its size does not depend on the data; a fuller map only lets more rows through.

    Pages come to the driver and leave it compressed, so what the driver holds of a bitmap with few marks is small."""

    def __init__(self, df: DataFrame, col: str, bits: int = BITMAP):
        slot = f"shiftrightunsigned({col}, {64 - bits})"
        words = df.selectExpr(f"shiftright({slot}, 6) AS w", f"shiftleft(1L, cast({slot} & 63 AS int)) AS b") \
            .groupBy("w").agg(F.bit_or("b").alias("b")).withColumn("page", F.shiftright("w", PAGE))

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            page = np.zeros(1 << PAGE, dtype=np.int64)
            page[rows["w"].to_numpy() & ((1 << PAGE) - 1)] = rows["b"].to_numpy()
            return pd.DataFrame({"page": rows["page"][:1], "bits": [zlib.compress(page.tobytes(), 1)]})

        parts = max(1, (1 << max(0, bits - 6 - PAGE)) // TASK_PAGES)
        pages = [(r["page"], bytes(r["bits"])) for r in words.repartition(parts, "page").groupBy("page").applyInPandas(pack, "page long, bits binary").collect()]
        self.bits, self.sent = bits, df.sparkSession.sparkContext.broadcast(_Pages(1 << (bits - 6), pages))

    def destroy(self) -> None:
        """Free every copy, once the tables that were made with it are written."""
        self.sent.destroy()

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return (self.sent.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
