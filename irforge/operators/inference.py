"""Pluggable batch inference on tables (X1, X2, X4) and the bundled stand-ins.

Model runtimes are not Spark work; what Spark does is feed Arrow batches to a user function once
per batch, with the model built once per Python worker.  The bundled encoder is a deterministic
hashed word-feature projection — a clearly labelled stand-in, not a neural model; the bundled
generator is the template rule over a passage's heaviest terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irforge.operators.textprep import question_from_terms

_MODELS: dict[str, object] = {}


def hashed_encoder(dim: int = 64, seed: int = 0) -> Callable[[list[str]], np.ndarray]:
    """Stand-in encoder: lower-cased word tokens hashed (xxhash64) into ``dim`` signed buckets,
    summed and L2-normalised."""
    import re

    import xxhash

    pat = re.compile(r"[^\W_]{2,}|_{2,}", re.UNICODE)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for tok in pat.findall((t or "").lower()):
                h = xxhash.xxh64_intdigest(tok, seed=seed)
                out[i, h % dim] += 1.0 if (h >> 63) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(n, 1e-12)
    return encode


def embed(df: DataFrame, text_col: str, out_col: str = "vec", encoder_factory: Callable[[], Callable] | None = None,
          key: str = "hashed64") -> DataFrame:
    """Add ``out_col`` ARRAY<DOUBLE> by running ``encoder(list[str]) -> ndarray`` over Arrow
    batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows at a time)."""
    factory = encoder_factory or (lambda: hashed_encoder())
    schema = df.select("*", F.lit(None).cast("array<double>").alias(out_col)).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _MODELS.get(key)
        if enc is None:
            enc = _MODELS[key] = factory()
        for pdf in it:
            vecs = enc(pdf[text_col].fillna("").tolist()) if len(pdf) else np.zeros((0, 1))
            pdf[out_col] = [v.astype(float).tolist() for v in vecs]
            yield pdf
    return df.mapInPandas(run, schema)


def template_candidates(top_terms: DataFrame, n: int, id_col: str = "docid") -> DataFrame:
    """X2 bundled generator: candidate c of a document uses its terms ranked 2c+1 and 2c+2."""
    terms = (top_terms.groupBy(id_col)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("term_rank", "term"))), lambda s: s["term"]).alias("terms")))
    c = terms.select(id_col, "terms", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cand"))
    pair = F.slice(F.col("terms"), F.col("cand") * 2 + 1, F.lit(2))
    return c.select(id_col, "cand", question_from_terms(F.coalesce(pair, F.array().cast("array<string>"))).alias("question"))


def generate(df: DataFrame, text_col: str, n: int, generator: Callable[[list[str], int], list[list[str]]],
             id_col: str = "docid") -> DataFrame:
    """``n`` candidates per row from a user generator run over Arrow batches: (docid, cand, question)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            outs = generator(pdf[text_col].fillna("").tolist(), n) if len(pdf) else []
            rows = [(d, c, q) for d, qs in zip(pdf[id_col], outs) for c, q in enumerate(qs)]
            out = pd.DataFrame(rows, columns=[id_col, "cand", "question"])
            yield out.astype({"cand": "int32"}) if len(out) else pd.DataFrame(
                {id_col: pd.Series([], dtype="object"), "cand": pd.Series([], dtype="int32"),
                 "question": pd.Series([], dtype="object")})
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} string, cand int, question string")


def mmr_with(pool: DataFrame, seeds: DataFrame, seed_sim: Callable[[np.ndarray, np.ndarray], np.ndarray],
             pair_sim: Callable[[np.ndarray], np.ndarray], lam: float, id_col: str = "docid") -> DataFrame:
    """MMR with caller-supplied similarity functions, evaluated per cluster on the pool matrix:
    ``seed_sim(X, seed) -> (n,)`` and ``pair_sim(X) -> (n, n)``.  ``pool``: (cid, docid, vec);
    ``seeds``: (cid, seed_vec).  One group is one cluster's pool (bounded by 5 x sample size); no
    pair rows are materialised."""
    from irforge.operators.sampling import mmr_order
    g = pool.join(seeds, "cid")

    def per_cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
        seed = np.asarray(pdf["seed_vec"].iloc[0], dtype=np.float64)
        res = mmr_order(np.asarray(seed_sim(X, seed), dtype=float), np.asarray(pair_sim(X), dtype=float),
                        pdf[id_col].astype(str).to_numpy(), lam)
        out = pd.DataFrame(res, columns=[id_col, "mmr_score", "mmr_step"])
        out["cid"] = int(pdf["cid"].iloc[0])
        return out[["cid", id_col, "mmr_score", "mmr_step"]]
    return g.groupBy("cid").applyInPandas(per_cluster, f"cid int, {id_col} string, mmr_score double, mmr_step long")
