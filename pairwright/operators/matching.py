"""Locally dominant matching: a deterministic half-approximation of the maximum-weight matching.

Every vertex points to its heaviest free neighbour, of equal ones to that with the larger id; edges whose ends
point at each other are matched and their neighbours drop out; repeat. The result is the greedy
matching by descending (weight, larger end, smaller end), whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.graph import arcs_of
from pairwright.plans.schema import EDGES
from pairwright.plans.storage import Scratch

#: Weights below this are no candidates.
LEAST_WEIGHT = -1.0
#: Up to so many edges (24 bytes each) one task finishes greedily; the result is the same.
FINISH_EDGES = 1_000_000
#: Rounds of a task before it goes edge by edge, which long ascending paths need.
TASK_ROUNDS = 40
#: Matched vertices (8 bytes each) that are broadcast to prune the edges; more are joined by shuffle.
BROADCAST_VERTICES = 1_000_000


def eligible(edges: DataFrame, least: float = LEAST_WEIGHT, strict: bool = False) -> DataFrame:
    """Edges that may be matched: no self loop, and a weight of at least ``least`` (above it, if ``strict``). Spark sorts NaN highest, so it has to go."""
    heavy = F.col("w") > least if strict else F.col("w") >= least
    return edges.filter("u <> v").filter(heavy & ~F.isnan("w"))


def pointers(arcs: DataFrame) -> DataFrame:
    """``u, p, w``: each source's heaviest arc, ties to the larger target."""
    best = arcs.groupBy(F.col("src").alias("u")).agg(F.max(F.struct("w", "dst")).alias("best"))
    return best.select("u", F.col("best.dst").alias("p"), F.col("best.w").alias("w"))


def mutual(chosen: DataFrame) -> DataFrame:
    """``u < v, w`` of vertices that point at each other: pairs that are pointed along from both ends. An aggregation instead of a self-join."""
    pair = chosen.groupBy(F.least("u", "p").alias("u"), F.greatest("u", "p").alias("v")).agg(F.count("*").alias("n"), F.max("w").alias("w"))
    return pair.filter("n = 2").select("u", "v", "w")


def prune(edges: DataFrame, matched: DataFrame, few: bool = False) -> DataFrame:
    """Edges with both ends free of ``matched (id)``."""
    gone = F.broadcast(matched) if few else matched
    left = edges.join(gone.withColumnRenamed("id", "u"), "u", "left_anti")
    return left.join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v", "w")


def still_valid(chosen: DataFrame, matched: DataFrame, few: bool = False) -> DataFrame:
    """``u, p, w, valid`` of the pointers of free vertices: whether the vertex pointed at is free, too. Only the others point anew."""
    gone = F.broadcast(matched) if few else matched
    free = chosen.join(gone.withColumnRenamed("id", "u"), "u", "left_anti")
    lost = gone.select(F.col("id").alias("p"), F.lit(False).alias("valid"))
    return free.join(lost, "p", "left").select("u", "p", "w", F.coalesce("valid", F.lit(True)).alias("valid"))


def greedy(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions of the edges that taking them by descending (weight, larger end, smaller end) keeps, and the rounds
    in which mutual pointers would find them."""
    order = np.lexsort((np.minimum(u, v), np.maximum(u, v), w))[::-1]
    ids, ends = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    live, taken, keep, rounds = np.arange(len(u)), np.zeros(len(ids), bool), [], 0
    while rounds < TASK_ROUNDS and len(live):
        rounds += 1
        best = np.full((2, len(ids)), len(u))
        best[0][a[live][::-1]] = live[::-1]  # of an end's edges the first one stays
        best[1][b[live][::-1]] = live[::-1]
        best = best.min(0)
        won = live[(best[a[live]] == live) & (best[b[live]] == live)]
        keep.append(won)
        taken[a[won]] = taken[b[won]] = True
        live = live[~(taken[a[live]] | taken[b[live]])]
    # What is left goes edge by edge. An edge is mutual in the round after its heavier neighbours have all gone, that is after the
    # last of those that took an end of each; a vertex or edge is gone in the round in which a neighbour was matched.
    rest, gone_in = [], np.full(len(ids), rounds)
    for i, x, y in zip(live.tolist(), a[live].tolist(), b[live].tolist()):
        if taken[x] or taken[y]:
            when = min(gone_in[e] for e in (x, y) if taken[e])
            for e in (x, y):
                if not taken[e]:
                    gone_in[e] = max(gone_in[e], when)
        else:
            taken[x] = taken[y] = True
            gone_in[x] = gone_in[y] = max(gone_in[x], gone_in[y]) + 1
            rest.append(i)
    return order[np.concatenate([*keep, np.array(rest, int)])], int(gone_in.max(initial=rounds))


def _greedy(batches):
    """The rest of a graph in one task: pairs, and a row without ends whose weight is the number of rounds."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows)
        columns = [t.column(c).to_numpy() for c in ("u", "v", "w")]
        keep, rounds = greedy(*columns)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["u", "v", "w"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([float(rounds)])], ["u", "v", "w"])


@dataclass
class Matching:
    """``pairs``: u < v with weight. ``rounds``: those that matched something, wherever they ran."""

    pairs: DataFrame
    rounds: int

    def mates(self) -> DataFrame:
        """``u, v`` in both directions."""
        return arcs_of(self.pairs).select(F.col("src").alias("u"), F.col("dst").alias("v"))

    def summary(self) -> DataFrame:
        """Matched vertices, pairs, weight, and the weight counted from both ends."""
        weight = F.coalesce(F.sum("w"), F.lit(0.0))
        return self.pairs.agg((2 * F.count("*")).alias("matched_vertices"), F.count("*").alias("pairs"), weight.alias("matching_weight"), (2 * weight).alias("both_ends_weight"))


def locally_dominant(edges: DataFrame, least: float = LEAST_WEIGHT, strict: bool = False, finish_edges: int = FINISH_EDGES) -> Matching:
    """Match canonical edges ``(u < v, w)``, each pair once.

    A round finds the mutual pairs of all pointers, prunes the edges of matched vertices, and lets those
    vertices point anew whose pointer lost its target; all of it is stored in the shared folder, so lineage stays short
    and a lost executor costs a task. Matched vertices, and those that point anew, are broadcast only where a count says that
    they are few. The heaviest edge that is left is always mutual, so every round matches something.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "matching")
    now, left = scratch.counted(eligible(edges, least, strict).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("w").cast("double").alias("w")), "edges")
    found, rounds, chosen = [], 0, None
    while left > finish_edges:
        again = left > 2 * finish_edges  # else this is likely the last round, and pointers need not be kept
        if chosen is None:
            chosen = scratch.write(pointers(arcs_of(now)), "pointers") if again else pointers(arcs_of(now))
        pairs, n = scratch.counted(mutual(chosen), "pairs")
        found.append(pairs)
        rounds += 1
        few = 2 * n <= BROADCAST_VERTICES
        matched = pairs.select(F.explode(F.array("u", "v")).alias("id"))
        before = now
        now, left = scratch.counted(prune(now, matched, few), "edges")
        scratch.drop(before)
        before, chosen = chosen, _anew(scratch, still_valid(chosen, matched, few), now) if again and left > finish_edges else None
        scratch.drop(before)
    if left:
        rest = scratch.write(now.coalesce(1).mapInArrow(_greedy, EDGES), "rest")
        rounds += int(rest.filter("u is null").first().w)
        found.append(rest.filter("u is not null"))
    scratch.drop(now)
    out = spark.createDataFrame([], EDGES)
    for pairs in found:
        out = out.unionByName(pairs) if found[0] is not pairs else pairs
    return Matching(out, rounds)


def _anew(scratch: Scratch, chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """All pointers after a round: those that hold, and new ones of the vertices whose pointer lost its target."""
    chosen = scratch.write(chosen, "chosen")
    lost, n = scratch.counted(chosen.filter("not valid").select(F.col("u").alias("src")), "lost")
    arcs = arcs_of(edges).join(F.broadcast(lost) if n <= BROADCAST_VERTICES else lost, "src", "left_semi")
    out = scratch.write(chosen.filter("valid").select("u", "p", "w").unionByName(pointers(arcs)), "pointers")
    scratch.drop(chosen, lost)
    return out


def mate_weights(mates: DataFrame, arcs: DataFrame) -> DataFrame:
    """``u, v, w`` of each mate: the heaviest of parallel arcs."""
    top = arcs.groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.max("w").alias("w"))
    return mates.select("u", "v").join(top, ["u", "v"])
