"""Degrees, weighted degrees and what describes their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.graph import vertices_of


def vertex_stats(arcs: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, degree, weighted_degree, max_weight``; one aggregation, and a join so that vertices without arcs stay.
    The largest weight starts at zero: a vertex with only negative arcs has 0."""
    own = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"), F.max("w").alias("top"))
    all_ = vertices if vertices is not None else vertices_of(arcs)
    return all_.join(own, "id", "left").select(
        "id",
        F.coalesce("degree", F.lit(0)).cast("long").alias("degree"),
        F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"),
        F.greatest(F.lit(0.0), F.coalesce("top", F.lit(0.0))).alias("max_weight"),
    )


def degree_summary(arcs: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One row: vertices, arcs, largest, median and mean square degree, variance and standard deviation."""
    d = F.col("degree").cast("double")
    spread = F.avg(d * d) - F.avg(d) * F.avg(d)
    return vertex_stats(arcs, vertices).agg(
        F.count("*").alias("vertices"),
        F.sum("degree").alias("arcs"),
        F.max("degree").alias("max_degree"),
        F.percentile("degree", F.lit(0.5)).alias("median_degree"),
        F.round(F.avg(d * d), 6).alias("mean_square"),
        F.round(F.abs(spread), 6).alias("variance"),
        F.round(F.sqrt(F.abs(spread)), 6).alias("stddev"),
    )


def total_mass(arcs: DataFrame) -> DataFrame:
    """Half the sum of all arc weights: the weight of all undirected edges."""
    return arcs.agg((F.coalesce(F.sum("w"), F.lit(0.0)) * 0.5).alias("mass"))
