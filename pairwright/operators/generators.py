"""Random graphs, each edge computed by itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.graph import arcs_of

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: pseudo-random bits of a number and a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(31))


def attached(edge: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of preferential-attachment edges by number.

    Edges 0..m-1 are a star around vertex 0. Edge e beyond belongs to vertex m + 1 + (e - m) // m and points
    to an end of a uniformly chosen arc of all vertices before. Which end that is follows from that
    arc's own number: its new vertex, or again a random choice, which is traced back by hash. So any
    edge is known without the others, after a logarithm of steps on average.
    """
    source = np.where(edge < m, 0, m + 1 + (edge - m) // m)
    target, open_ = np.where(edge < m, edge + 1, -1), np.flatnonzero(edge >= m)
    at = edge[open_]
    while len(open_):
        before = 2 * (m + (at - m) // m * m)  # arcs of the vertices before this edge's
        arc = (mixed(at, seed) % before.astype(np.uint64)).astype(np.int64)
        parent, even = arc // 2, arc % 2 == 0
        new = np.where(parent < m, 0, m + 1 + (parent - m) // m)
        known = even | (parent < m)
        target[open_[known]] = np.where(even, new, parent + 1)[known]
        open_, at = open_[~known], parent[~known]
    return source, target


def weights(edge: np.ndarray, seed: int, uniform: bool = False) -> np.ndarray:
    """|N(1, 1)|, or U(0, 1): by edge number, so both arcs of an edge agree."""
    u = (mixed(edge, seed + 1) >> np.uint64(11)).astype(np.float64) / 2**53
    if uniform:
        return u
    v = (mixed(edge, seed + 2) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.abs(1 + np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v))


def scale_free(spark: SparkSession, n: int, m: int, seed: int = 42, uniform: bool = False, parts: int | None = None) -> DataFrame:
    """Arcs, both directions, of a graph with ``n`` vertices in which every vertex beyond the first ``m + 1`` attaches ``m`` times;
    parallel edges may occur. Independent of the partitioning."""
    if not 1 <= m < n:
        raise ValueError("1 <= m < n")
    edges = m + (n - m - 1) * m

    def make(batches):
        for batch in batches:
            e = batch.column(0).to_numpy()
            u, v = attached(e, m, seed)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(weights(e, seed, uniform))], ["u", "v", "w"])

    return arcs_of(spark.range(0, edges, 1, parts or spark.sparkContext.defaultParallelism).mapInArrow(make, "u long, v long, w double"))


def random_weights(arcs: DataFrame, seed: int = 42) -> DataFrame:
    """``arcs`` with weights U(0, 1) that depend on the two ends alone, so that the graph stays symmetric."""
    return arcs.withColumn("w", unit_hash(F.least("src", "dst"), F.greatest("src", "dst"), seed))


def unit_hash(a: Column, b: Column, seed: int) -> Column:
    bits = F.xxhash64(a, b, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    return bits.cast("double") / float(1 << 53)
