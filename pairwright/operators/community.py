"""Communities: weights, moves, modularity, coarsening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.graph import arcs_of, canonical, dense_ids
from pairwright.plans.storage import Scratch, temporary

DIGITS = 9


def singletons(vertices: DataFrame) -> DataFrame:
    """Every vertex a community of its own."""
    return vertices.select("id", F.col("id").alias("c"))


def community_weights(strengths: DataFrame, comm: DataFrame) -> DataFrame:
    """``c, w``: the weighted degrees ``(id, k)`` summed by community."""
    return strengths.join(comm, "id").groupBy("c").agg(F.sum("k").alias("w"))


def updated_weights(weights: DataFrame, strengths: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Community weights after vertices moved from ``old`` to ``new``: only the movers' weights travel."""
    moved = old.withColumnRenamed("c", "a").join(new.withColumnRenamed("c", "b"), "id").filter("a <> b").join(strengths, "id")
    change = moved.select(F.explode(F.array(F.struct(F.col("a").alias("c"), (-F.col("k")).alias("w")), F.struct(F.col("b").alias("c"), F.col("k").alias("w")))).alias("x")).select("x.*")
    return weights.unionByName(change).groupBy("c").agg(F.sum("w").alias("w"))


def links(arcs: DataFrame, comm: DataFrame) -> DataFrame:
    """``src, c, w``: what each vertex's arcs weigh into each community."""
    to = comm.withColumnRenamed("id", "dst")
    return arcs.join(to, "dst").groupBy("src", "c").agg(F.sum("w").alias("w"))


def distinct_communities(arcs: DataFrame, comm: DataFrame) -> DataFrame:
    """``src, n``: how many communities a vertex's arcs reach."""
    return arcs.join(comm.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.countDistinct("c").alias("n"))


def strengths_of(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))


def move(arcs: DataFrame, comm: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """``id, c, gain``: one synchronous move of all vertices to where modularity gains most, if it gains.

    The gain of moving to c is (w(v, c) - k W_c / 2m) / m, of staying (w(v, own) without loops - k (W_own - k) / 2m) / m.
    Of equal gains (to 9 digits) the smallest community counts.

    ``strengths``, the weighted degrees, may be given where they are known. What vertices weigh into communities is aggregated
    once, and one more aggregation by vertex finds both the best other community and what binds a vertex to its own.
    """
    spark = arcs.sparkSession
    scratch = Scratch(spark, "move")
    strengths = scratch.write(strengths_of(arcs), "strengths") if strengths is None else strengths
    m = (strengths.agg(F.sum("k")).first()[0] or 0.0) * 0.5
    home = scratch.write(comm.join(strengths, "id").select("id", F.col("c").alias("own"), "k"), "home")
    weights = home.groupBy("own").agg(F.sum("k").alias("total"))
    into = links(arcs.filter("src <> dst"), home.select("id", F.col("own").alias("c"))).join(weights.withColumnRenamed("own", "c"), "c")
    met = home.join(into.withColumnRenamed("src", "id"), "id", "left")
    gain = F.round((F.col("w") - F.col("k") * F.col("total") / F.lit(2 * m)) / F.lit(m), DIGITS)
    away = F.when(F.col("c") != F.col("own"), F.struct((-gain).alias("g"), F.col("c")))
    inside = F.coalesce(F.sum(F.when(F.col("c") == F.col("own"), F.col("w"))), F.lit(0.0))
    best = met.groupBy("id", "own", "k").agg(F.min(away).alias("best"), inside.alias("inside")).join(weights, "own")
    stay = F.round((F.col("inside") - F.col("k") * (F.col("total") - F.col("k")) / F.lit(2 * m)) / F.lit(m), DIGITS)
    better = F.round(-F.col("best.g") - stay, DIGITS)
    wins = F.coalesce(better > 0, F.lit(False))
    return best.select("id", F.when(wins, F.col("best.c")).otherwise(F.col("own")).alias("c"), F.when(wins, better).otherwise(F.lit(0.0)).alias("gain"))


def modularity(arcs: DataFrame, comm: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """One row: the sum over vertices of w(v, own) / 2m less the sum over communities of (W / 2m) squared."""
    ends = arcs.join(comm.withColumnRenamed("id", "src").withColumnRenamed("c", "a"), "src").join(comm.withColumnRenamed("id", "dst").withColumnRenamed("c", "b"), "dst")
    inside = ends.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("inside"), F.sum("w").alias("mass2"))
    square = community_weights(strengths_of(arcs) if strengths is None else strengths, comm).agg(F.sum(F.col("w") * F.col("w")).alias("square"))
    q = F.col("inside") / F.col("mass2") - F.col("square") / (F.col("mass2") * F.col("mass2"))
    return inside.join(F.broadcast(square)).select(F.round(q, DIGITS).alias("modularity"))


def coarsen(arcs: DataFrame, comm: DataFrame) -> DataFrame:
    """Arcs between communities, weights summed; those within one become a self loop."""
    out = arcs.join(comm.withColumnRenamed("id", "src").withColumnRenamed("c", "a"), "src").join(comm.withColumnRenamed("id", "dst").withColumnRenamed("c", "b"), "dst")
    return out.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def renumbered(comm: DataFrame) -> DataFrame:
    """``id, c``: communities numbered densely from 0."""
    return comm.join(dense_ids(comm, "c", "n"), "c").select("id", F.col("n").alias("c"))


def composed(comm: DataFrame, mapping: DataFrame) -> DataFrame:
    """``id, c``: the community ``mapping (id, c)`` gives to each vertex's community."""
    return comm.join(mapping.withColumnRenamed("c", "to").withColumnRenamed("id", "c"), "c").select("id", F.col("to").alias("c"))


def louvain(arcs: DataFrame, threshold: float = 1e-6, sweeps: int = 10, phases: int = 10) -> DataFrame:
    """``id, c``: sweeps of moves and coarsening for as long as modularity rises by ``threshold``.

    Moves are synchronous, so a sweep can lower modularity; the best assignment seen counts. To keep pairs from
    swapping places for ever, odd sweeps move only to smaller community ids and even ones only to larger.
    """
    spark = arcs.sparkSession
    scratch = Scratch(spark, "louvain")
    alone = lambda df: scratch.write(singletons(df.select(F.explode(F.array("src", "dst")).alias("id")).distinct()), "comm")
    now = scratch.write(arcs, "arcs")
    result = alone(now)
    for _ in range(phases):
        with temporary(spark, keep=scratch):  # what a phase leaves behind but for its result goes
            strengths = scratch.write(strengths_of(now), "strengths")
            comm = top = alone(now)
            start = best = modularity(now, comm, strengths).first()[0] or 0.0
            for sweep in range(sweeps):
                wanted = move(now, comm, strengths).select("id", F.col("c").alias("to"))
                allowed = F.col("to") < F.col("c") if sweep % 2 == 0 else F.col("to") > F.col("c")
                before, comm = comm, scratch.write(comm.join(wanted, "id").select("id", F.when(allowed, F.col("to")).otherwise(F.col("c")).alias("c")), "comm")
                if before is not top:
                    scratch.drop(before)
                q = modularity(now, comm, strengths).first()[0] or 0.0
                if q > best + threshold:
                    scratch.drop(top)
                    best, top = q, comm
                elif sweep % 2:
                    break
            done = best <= start + threshold
            if not done:
                old = now, result
                result = scratch.write(composed(result, top), "comm")
                now = scratch.write(coarsen(now, top), "arcs")
                scratch.drop(*old)
            scratch.drop(strengths, comm, top)
        if done:
            break
    out = scratch.write(renumbered(result), "out")
    scratch.drop(now, result)
    return out


def simple_arcs(arcs: DataFrame) -> DataFrame:
    return arcs_of(canonical(arcs))
