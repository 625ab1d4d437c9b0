"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.plans.storage import Scratch

#: Up to so many edges (16 bytes each) one task finishes the job; the result is the same.
ONE_TASK_EDGES = 100_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b, sorted, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The same components with fewer edges: each node linked to the smallest one."""
    nodes, low = labels(a, b)
    keep = nodes != low
    return pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(nodes[keep])], ["a", "b"])


def _finish(batches):
    got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if got:
        nodes, low = labels(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], ["node", "component"])


def connected_components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; component is its smallest node.

    Alternates the large-star and small-star steps until the edges are stars (a logarithmic
    number of rounds in practice). Each round is two aggregations with partial sums and two
    joins whose skew AQE splits, and its state is a table in the shared folder. What is small
    enough, by count, is finished in one task instead. Null ends and self loops are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = scratch.write(edges.filter("a is not null and b is not null and a <> b").select(low, high).distinct(), "edges")
    n, print_ = _state(now)
    while n > one_task_edges:
        large = scratch.write(_large_star(now), "large")
        small = scratch.write(_small_star(large), "small")
        scratch.drop(now, large)
        now, before = small, (n, print_)
        n, print_ = _state(now)
        if (n, print_) == before:
            ends = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return ends.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return now.coalesce(1).mapInArrow(_finish, "node long, component long")


def _state(edges: DataFrame) -> tuple:
    x = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return x.n, x.x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return linked.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
