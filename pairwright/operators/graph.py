"""Arcs and edges: canonical form, validation, neighbours, positions and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.plans.storage import Scratch


def arcs_of(edges: DataFrame) -> DataFrame:
    """Both directions of every edge ``(u, v, w)`` as ``(src, dst, w)``, in one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), "w"), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), "w")))
    return edges.select(both.alias("a")).select("a.*")


def canonical(arcs: DataFrame) -> DataFrame:
    """Undirected simple edges ``u < v`` of arcs in any directions: of parallel ones the heaviest, no self loops.
    Arcs with a null or NaN weight, or a null end, are no edges."""
    ends = arcs.filter("src <> dst and w is not null and not isnan(w)").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("w").cast("double").alias("w"))
    return ends.groupBy("u", "v").agg(F.max("w").alias("w"))


def asymmetric(arcs: DataFrame) -> DataFrame:
    """Arcs whose reverse, with the same weight and as often, is missing: empty for a valid undirected graph.
    One aggregation: each pair of ends counts its arcs up in one direction and down in the other."""
    sign = F.when(F.col("src") < F.col("dst"), 1).otherwise(-1)
    ends = arcs.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "w", sign.alias("s"))
    return ends.groupBy("u", "v", "w").agg(F.sum("s").alias("surplus")).filter("surplus <> 0")


def checked(arcs: DataFrame) -> DataFrame:
    """``arcs`` as canonical edges, or an error if they aren't symmetric."""
    if not asymmetric(arcs).isEmpty():
        raise ValueError("arcs without their reverse: pass them to canonical() to make them edges")
    return canonical(arcs)


def vertices_of(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def vertex_range(spark, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n)


def neighbors(arcs: DataFrame, vertex: int) -> DataFrame:
    """``dst, w`` of one vertex's arcs; the filter reaches the scan."""
    return arcs.filter(F.col("src") == vertex).select("dst", "w")


def without_loop_weight(arcs: DataFrame) -> DataFrame:
    """The same arcs, self loops with weight zero."""
    return arcs.withColumn("w", F.when(F.col("src") == F.col("dst"), F.lit(0.0)).otherwise(F.col("w")))


def arc_positions(arcs: DataFrame) -> DataFrame:
    """``pos``: an arc's place, from 0, among its source's arcs by target.

    Arcs are range partitioned by source, target and weight, so a hub's arcs lie in many partitions; each numbers its own
    part, and adds what the partitions before it hold of the same source.
    """
    scratch = Scratch(arcs.sparkSession, "positions")
    order = ["src", "dst", "w"]
    ranged = scratch.write(arcs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("src", "__p").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("src").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A partition goes on with one source at most, so these are fewer rows than partitions.
    later = F.broadcast(parts.select("src", "__p", ahead.alias("__ahead")).filter("__ahead > 0"))
    inner = F.row_number().over(Window.partitionBy("src", "__p").orderBy("dst", "w")) - 1
    numbered = ranged.withColumn("__i", inner).join(later, ["src", "__p"], "left")
    return numbered.select(*arcs.columns, (F.col("__i") + F.coalesce("__ahead", F.lit(0))).cast("long").alias("pos"))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Prefix sums ``{value: name}`` in a total order, without a window over the whole table: rows are range
    partitioned, partitions are summed, and each adds what all before it have."""
    scratch = Scratch(df.sparkSession, "running")
    ranged = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__p").agg(*[F.sum(v).alias(f"__t_{o}") for v, o in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = F.broadcast(totals.select("__p", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__ahead_{o}") for o in sums.values()]))
    inner = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = ranged.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"__own_{o}") for v, o in sums.items()])
    return own.join(totals, "__p").select(*df.columns, *[(F.col(f"__own_{o}") + F.col(f"__ahead_{o}")).alias(o) for o in sums.values()])


def running_sum(df: DataFrame, order: list[str], value: str, out: str, inclusive: bool = True) -> DataFrame:
    return running_sums(df, order, {value: out}, inclusive)


def dense_ids(ids: DataFrame, column: str = "id", out: str = "idx") -> DataFrame:
    """Distinct values numbered from 0 in their order."""
    distinct = ids.select(column).distinct().withColumn("__one", F.lit(1).cast("long"))
    return running_sum(distinct, [column], "__one", out, inclusive=False).select(column, F.col(out).cast("long").alias(out))


def csr_offsets(arcs: DataFrame) -> DataFrame:
    """``id, idx, degree, first, last``: vertices numbered by id, and the half-open range of their arcs when arcs are sorted by source.

    One aggregation counts both ends, a target's end as no arc; its rows, one a vertex, are stored, as
    cutting them into ranges reads them twice.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).cast("long").alias("n")), F.struct(F.col("dst").alias("id"), F.lit(0).cast("long").alias("n"))))
    degrees = arcs.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.n").alias("degree"), F.lit(1).cast("long").alias("__one"))
    scratch = Scratch(arcs.sparkSession, "offsets")
    stored = scratch.write(degrees, "degrees")
    summed = running_sums(stored, ["id"], {"__one": "idx", "degree": "first"}, inclusive=False)
    return summed.select("id", F.col("idx").cast("long").alias("idx"), "degree", F.col("first").cast("long").alias("first"), (F.col("first") + F.col("degree")).cast("long").alias("last"))


def sorted_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.orderBy("src", "dst", "w")


def smallest_arc(arcs: DataFrame) -> DataFrame:
    """The first arc by source, target and weight: what a priority heap would pop. An aggregate, no sort."""
    return arcs.agg(F.min(F.struct("src", "dst", "w")).alias("a")).select("a.*")
