"""Distributed connected components over an edge table (large-star / small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irforge.llm.base import fitted
from irforge.session import materialize


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    A round hooks all larger neighbours of a node to the smallest of its neighbourhood, then the node
    and its smaller neighbours; the edge table never grows beyond its start, and the number of
    rounds is logarithmic in practice.  A hub is a hot join key only, never a collected group: minima
    combine before the shuffle and the join back is split by the adaptive skew join.  Rounds are
    written to the shared checkpoint folder, and a round has one partition for every 100,000 edges, so a
    small edge table needs no shuffle.  Null ends and loops are ignored.
    """
    big, small = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = materialize(edges.where(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct())
    state = _state(e)
    while state[0]:
        e = fitted(e, state[0])
        both = fitted(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), state[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(parent, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(parent.select("u", F.col("m").alias("v")))
        e = materialize(fitted(star.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), state[0]).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
