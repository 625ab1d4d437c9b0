"""Cutting a graph's vertices into ranges, and placing edges on a grid of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.plans.storage import Scratch

#: What an edge of one byte a unit takes of memory, buffers included.
BYTES_PER_UNIT = 8.25


def edge_balanced(offsets: DataFrame, parts: int) -> DataFrame:
    """``part, lo, hi``: ranges of vertex numbers whose borders are nearest to equal numbers of arcs, of two as near the smaller.

    ``offsets`` is :func:`graph.csr_offsets`. All borders come from one aggregation; no sort, no search by the driver.
    """
    offsets = Scratch(offsets.sparkSession, "offsets").write(offsets.select("idx", "first", "last"))
    size = offsets.agg(F.coalesce(F.max("last"), F.lit(0)).alias("ne"), F.count("*").alias("nv")).first()
    borders = offsets.select("idx", F.col("first").alias("at"))
    nearest = [F.min(F.struct(F.abs(F.col("at") - F.lit(i * size.ne // parts)), F.col("idx"))).alias(f"c{i}") for i in range(1, parts)]
    ends = [(i * size.ne // parts) for i in range(1, parts)]
    got = borders.agg(*nearest).first() if nearest and size.nv else None
    cuts = [0]
    for i, target in enumerate(ends, 1):
        near = got[f"c{i}"] if got else None
        last = abs(size.ne - target)  # the end of the last vertex is a border too
        cuts.append(size.nv if near is None or last < near[0] else near[1])
    return _ranges(offsets.sparkSession, [*cuts, size.nv])


def edge_balanced_within(offsets: DataFrame, ranges: DataFrame, batches: int) -> DataFrame:
    """``part, batch, lo, hi``: every range of ``ranges (part, lo, hi)`` cut once more, so that its batches have near equal arcs.
    Borders are nearest to equal steps of the range's own arcs, of two as near the smaller; all ranges in one aggregation."""
    offsets = Scratch(offsets.sparkSession, "offsets").write(offsets.select("idx", "first", "last"))
    end = offsets.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("idx"), F.coalesce(F.max("last"), F.lit(0)).alias("at"))
    borders = offsets.select("idx", F.col("first").alias("at")).unionByName(end)
    r = F.broadcast(ranges)  # as many rows as parts
    inside = borders.join(r, (F.col("idx") >= r.lo) & (F.col("idx") <= r.hi)).select("part", "lo", "hi", "idx", "at")
    spans = inside.groupBy("part", "lo", "hi").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    wanted = spans.select("part", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("batch"))
    step = F.expr(f"(b - a) div {batches}")
    target = F.when(F.col("batch") == batches, F.col("b")).otherwise(F.col("a") + F.col("batch") * step)
    wanted = F.broadcast(wanted.select("part", "batch", target.alias("target")))  # parts * (batches + 1) rows
    near = F.min(F.struct(F.abs(F.col("at") - F.col("target")), F.col("idx"))).alias("near")
    cuts = inside.join(wanted, "part").groupBy("part", "lo", "hi", "batch").agg(near)
    cut = F.when(F.col("batch") == 0, F.col("lo")).when(F.col("batch") == batches, F.col("hi")).otherwise(F.col("near.idx"))
    placed = cuts.select("part", "batch", cut.alias("lo"))
    after = F.lead("lo").over(Window.partitionBy("part").orderBy("batch"))
    return placed.withColumn("hi", after).filter("hi is not null").select(F.col("part").cast("int").alias("part"), F.col("batch").cast("int").alias("batch"), "lo", "hi")


def vertex_balanced(spark, n: int, parts: int) -> DataFrame:
    """``part, lo, hi``: equal numbers of vertices, the rest to the last part."""
    return _ranges(spark, [*(i * (n // parts) for i in range(parts)), n])


def greedy(offsets: DataFrame, capacity: int, overflow: bool = True) -> DataFrame:
    """``part, lo, hi`` filled one after the other: a range ends behind the vertex that takes it over ``capacity``
    arcs, or without ``overflow`` before it (a vertex over the capacity has a range of its own).

    One aggregation a range, over the stored rows near its end only: the vertex that takes a range over its
    capacity ends at most the largest degree beyond it, and the files know their smallest and largest offsets. The
    offsets never leave the cluster.
    """
    offsets = Scratch(offsets.sparkSession, "offsets").write(offsets.select("idx", "degree", "first", "last"))
    size = offsets.agg(F.coalesce(F.max("last"), F.lit(0)).alias("ne"), F.count("*").alias("nv"), F.coalesce(F.max("degree"), F.lit(0)).alias("most")).first()
    cuts, start = [0], 0
    while cuts[-1] < size.nv:
        over = offsets.filter((F.col("idx") >= cuts[-1]) & (F.col("last") > start + capacity) & (F.col("last") <= start + capacity + size.most)).agg(F.min(F.struct("idx", "first", "last")).alias("o")).first().o
        if over is None:
            cuts.append(size.nv)
        elif overflow or over.idx == cuts[-1]:
            cuts.append(over.idx + 1)
            start = over.last
        else:
            cuts.append(over.idx)
            start = over.first
    return _ranges(offsets.sparkSession, cuts)


def capacity(free_bytes: int, vertices: int, edges: int, unit: int) -> int:
    """Arcs that fit beside the state of all vertices (four ids and two weights each), at most all."""
    room = free_bytes - 48 * vertices
    return max(0, min(edges, int(room / unit / BYTES_PER_UNIT))) if vertices else 0


def _ranges(spark, cuts: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "part int, lo long, hi long")


def locate(ids: DataFrame, ranges: DataFrame, column: str = "idx") -> DataFrame:
    """``ids`` with the ``part`` that holds ``column`` and its ``offset`` there. Ranges are as many as partitions, so they are broadcast."""
    r = F.broadcast(ranges)
    return ids.join(r, (F.col(column) >= r.lo) & (F.col(column) < r.hi)).withColumn("offset", F.col(column) - F.col("lo")).drop("lo", "hi")


def hashed(column: str, parts: int) -> Column:
    """Partition of a vertex by hash: equal in every engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def local_vertices(ids: DataFrame, part: int, parts: int, column: str = "id") -> DataFrame:
    """The vertices that hash to one of ``parts`` partitions."""
    return ids.filter(hashed(column, parts) == part)


def local_edges(arcs: DataFrame, rank: int, parts: int) -> DataFrame:
    """The arcs whose ends put them on one rank of the process grid."""
    placed = on_grid(arcs, hashed("src", parts), hashed("dst", parts), parts)
    return placed.filter(F.col("rank") == rank).select(*arcs.columns)


def by_hash(arcs: DataFrame, parts: int) -> DataFrame:
    """Arcs dealt to ``parts`` partitions by both ends, so that a hub's arcs are spread."""
    return arcs.repartition(parts, "src", "dst")


def grid(parts: int) -> tuple[int, int]:
    """Rows and columns of the process grid: the largest divisor up to the root, and its counterpart."""
    rows = max(r for r in range(1, int(parts**0.5) + 1) if parts % r == 0)
    return rows, parts // rows


def edge_rank(edge_id: Column, parts: int) -> Column:
    """The rank on the process grid that an edge's id hashes to."""
    rows, columns = grid(parts)
    part = F.pmod(F.conv(F.substring(F.md5(edge_id.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    return ((part % rows) * columns + F.floor(part / rows)).cast("int")


def on_grid(arcs: DataFrame, major: Column, minor: Column, parts: int) -> DataFrame:
    """``arcs`` with where the vertex partitions of their ends put them: ``rank`` on the grid, ``edge_part``
    (one of parts * columns), ``local_part`` within the rank, and the local numbers of both ends' partitions."""
    rows, columns = grid(parts)
    out = arcs.withColumn("major_part", major.cast("int")).withColumn("minor_part", minor.cast("int"))
    column = F.expr(f"minor_part div {rows}").cast("int")
    return (
        out.withColumn("rank", (column * rows + F.col("major_part") % rows).cast("int"))
        .withColumn("edge_part", (F.col("major_part") * columns + column).cast("int"))
        .withColumn("local_part", F.expr(f"edge_part div {parts}").cast("int"))
        .withColumn("local_major", F.expr(f"major_part div {rows}").cast("int"))
        .withColumn("local_minor", (F.col("minor_part") % rows).cast("int"))
    )
