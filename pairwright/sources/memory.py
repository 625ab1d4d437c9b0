"""Graphs from lists in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pairwright.operators.coloring import relabel
from pairwright.operators.graph import arcs_of, checked, dense_ids, vertices_of
from pairwright.plans.schema import ARCS


def from_lists(spark: SparkSession, src: Sequence[int], dst: Sequence[int], w: Sequence[float] | None = None, renumber: bool = False, symmetric: bool = False) -> DataFrame:
    """Arcs of parallel lists, weight 1 where there are none. ``symmetric`` lists must hold both directions (an
    error, if not) and come back as they should be; of others the arcs are just those. ``renumber`` gives vertices dense ids from 0, by id."""
    weights = w if w is not None else [1.0] * len(src)
    if not len(src) == len(dst) == len(weights):
        raise ValueError("lists of different lengths")
    arcs = spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(src, dst, weights)], ARCS)
    if symmetric:
        arcs = arcs_of(checked(arcs))
    return relabel(arcs, dense_ids(vertices_of(arcs))) if renumber else arcs
