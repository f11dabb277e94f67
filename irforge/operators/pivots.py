"""Pivot bounds for inner-product threshold joins.

Vectors are put into groups by their nearest pivot (largest cosine) and the ring of their angle to it.  For vectors x, y
with angles a, b to pivots p, q, the triangle inequality on the sphere bounds the angle between x and y from below by
each of angle(p, q) - a - b, a - angle(p, q) - b and b - angle(p, q) - a.  Two groups whose ranges of angles and
largest norms leave no product above the threshold are never compared; the others are compared in full, so results are
the same as without pivots.

The pivots are a sample of at most ``MAX_PIVOTS`` rows in the order of a seeded hash; which they are changes the work only.
There are at most ``MAX_PIVOTS`` x ``RINGS`` groups however large the input is.
A zero vector lies in some group with the norm 0, which excludes it from products above a positive threshold.  A negative
threshold excludes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS = 256
RINGS = 16
SEED = 7
#: Slack of the bound in radians, far above the rounding of an arc cosine.
SLACK = 1e-6


@dataclass
class Pivots:
    points: np.ndarray  # unit rows

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, angle to the group's pivot and norm of each row."""
        norm = np.linalg.norm(x, axis=1)
        cos = np.clip(x / np.where(norm > 0, norm, 1.0)[:, None] @ self.points.T, -1.0, 1.0)
        cell = cos.argmax(axis=1)
        angle = np.nan_to_num(np.arccos(cos[np.arange(len(x)), cell]))
        ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int64), RINGS - 1)
        return cell * RINGS + ring, angle, norm

    def may_meet(self, a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> np.ndarray:
        """Whether groups of a and of b (columns g, lo, hi, norm) may hold a product of at least the threshold."""
        if threshold < 0:
            return np.ones((len(a), len(b)), dtype=bool)
        p, q = self.points[a["g"].to_numpy() // RINGS], self.points[b["g"].to_numpy() // RINGS]
        between = np.arccos(np.clip(p @ q.T, -1.0, 1.0))
        lo1, hi1 = a["lo"].to_numpy()[:, None], a["hi"].to_numpy()[:, None]
        lo2, hi2 = b["lo"].to_numpy()[None, :], b["hi"].to_numpy()[None, :]
        least = np.maximum(between - hi1 - hi2, np.maximum(lo1 - between - hi2, lo2 - between - hi1))
        norms = a["norm"].to_numpy()[:, None] * b["norm"].to_numpy()[None, :]
        cosine = np.where(norms > 0, threshold / np.where(norms > 0, norms, 1.0), np.inf if threshold > 0 else -1.0)
        return (cosine <= 1 + SLACK) & (least <= np.arccos(np.clip(cosine, -1.0, 1.0)) + SLACK)


def choose(df: DataFrame, n: int, id_col: str, vec: str) -> Pivots:
    """At most ``n`` (and ``MAX_PIVOTS``) pivots from ``df``."""
    rows = df.orderBy(F.xxhash64(F.lit(SEED), id_col), id_col).select(vec).limit(max(1, min(n, MAX_PIVOTS))).collect()
    return from_rows(np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), -1))


def from_rows(x: np.ndarray) -> Pivots:
    """Pivots in the directions of the rows; zero and non-finite rows give none."""
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    if not good.any():
        return Pivots(np.eye(1, x.shape[1]))
    return Pivots(x[good] / norm[good][:, None])


def placed(df: DataFrame, pivots: Pivots, vec: str) -> DataFrame:
    """``df`` with _g, _angle and _norm of each row."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("g long, angle double, norm double")
    def place(v: pd.Series) -> pd.DataFrame:
        g, angle, norm = sent.value.place(np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1))
        return pd.DataFrame({"g": g, "angle": angle, "norm": norm})

    return df.withColumn("_p", place(vec)).select(*df.columns, F.col("_p.g").alias("_g"), F.col("_p.angle").alias("_angle"), F.col("_p.norm").alias("_norm"))


def ranges(rows: DataFrame) -> pd.DataFrame:
    """(g, n, lo, hi, norm) of the groups of placed rows: at most ``MAX_PIVOTS`` x ``RINGS`` rows, in order of g."""
    return rows.groupBy(F.col("_g").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("lo"), F.max("_angle").alias("hi"), F.max("_norm").alias("norm")) \
        .toPandas().sort_values("g", ignore_index=True)


def ranges_of(g: np.ndarray, angle: np.ndarray, norm: np.ndarray) -> pd.DataFrame:
    """The same for the rows of one batch."""
    return pd.DataFrame({"g": g, "lo": angle, "hi": angle, "norm": norm}).groupby("g", as_index=False).agg({"lo": "min", "hi": "max", "norm": "max"})


def skipped_share(df: DataFrame, threshold: float, n_pivots: int, id_col: str = "docid", vec: str = "vec") -> float:
    """The part of all row pairs of a self-join that the bounds rule out."""
    pivots = choose(df, n_pivots, id_col, vec)
    r = ranges(placed(df, pivots, vec))
    n = r["n"].to_numpy(dtype=np.float64)
    return float(1.0 - (np.outer(n, n) * pivots.may_meet(r, r, threshold)).sum() / max(1.0, n.sum() ** 2))
