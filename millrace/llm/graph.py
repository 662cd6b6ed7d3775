"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and an equi-join; where edges are many, those of the few nodes with very many
neighbours are joined in place with a broadcast of these, so none costs a task more than its share. Edges live in shared-folder tables
between rounds; the driver sees a count and a checksum a round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, staged

#: A node with more than a HUBS-th part of all edges is a hub, where there are LARGE edges or more.
HUBS, LARGE = 1000, 1_000_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(r)


def _lowest(edges: DataFrame, value: Column) -> DataFrame:
    """(u, m, edges): the value of each u and how many edges it has."""
    return edges.groupBy("u").agg(value.alias("m"), F.count(F.lit(1)).alias("edges"))


def _beside(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with the m of u. Edges of a hub stay where they are, beside a broadcast of the hubs (at most 2 * HUBS rows); the others meet their m by a join."""
    if total < LARGE:
        return edges.join(low.drop("edges"), "u")
    most = max(1, total // HUBS)
    hubs = F.broadcast(low.where(F.col("edges") > most).drop("edges"))
    rest = low.where(F.col("edges") <= most).drop("edges")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(rest, "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable. rows: a bound on the number of edges.

    Null ends and loops are ignored. No edges give an empty table. Rounds: logarithmic in the longest path.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "edges", rows)
    was = _state(e)
    while was[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, F.least(F.min("v"), F.first("u")))
        large = _beside(both, low, 2 * was[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large, F.min("v"))
        small = _beside(large, low, was[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", 2 * was[0])
        now = _state(e)
        discard(last)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(hit: np.ndarray, one: np.ndarray, two: np.ndarray, same: bool) -> pd.DataFrame:
    """Edges that join what hit joins: each node reached is linked to the one it was reached from."""
    a, b = [], []
    if same:
        left = np.ones(len(one), bool)
        for start in np.flatnonzero(hit.any(axis=1)):
            if not left[start]:
                continue
            left[start] = False
            stack = [start]
            while stack:
                i = stack.pop()
                new = np.flatnonzero(hit[i] & left)
                left[new] = False
                a += [one[i]] * len(new)
                b += one[new].tolist()
                stack += new.tolist()
    else:
        rows, cols = np.ones(len(one), bool), np.ones(len(two), bool)
        for start in np.flatnonzero(hit.any(axis=1)):
            if not rows[start]:
                continue
            rows[start] = False
            stack = [(True, start)]
            while stack:
                row, i = stack.pop()
                new = np.flatnonzero(hit[i] & cols) if row else np.flatnonzero(hit[:, i] & rows)
                (cols if row else rows)[new] = False
                a += [(one if row else two)[i]] * len(new)
                b += (two if row else one)[new].tolist()
                stack += [(not row, j) for j in new]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
