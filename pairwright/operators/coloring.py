"""Greedy colouring by rounds: local priority maxima, and a run of the next vertices that one task colours."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.graph import running_sum
from pairwright.plans.storage import Scratch


#: Arcs and used colours of the vertices that one task colours in a round (32 bytes each); the result is the same.
FINISH_ARCS = 200_000
#: Stored tables of coloured vertices that are read together before they become one.
PARTS = 16


def _finish(batches):
    """Rows (id, p, dst, color): for each vertex that waits, its neighbours of higher priority, with their colours where they have
    one, and without a neighbour the colours that are used already."""
    waits: dict[tuple, list] = {}
    taken: dict[int, set] = {}
    colors: dict[int, int] = {}
    for batch in batches:
        for i, p, dst, c in zip(*(x.to_pylist() for x in batch.columns)):
            own = waits.setdefault((p, i), [])
            if dst is not None:
                own.append(dst)
                if c is not None:
                    colors[dst] = c
            elif c is not None:
                taken.setdefault(i, set()).add(c)
    new = {}
    for (_, i), neighbors in sorted(waits.items(), reverse=True):
        used = {colors[n] for n in neighbors} | taken.get(i, set())
        new[i] = colors[i] = next(c for c in range(len(used) + 1) if c not in used)
    yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.int64())], ["id", "color"])


def color(arcs: DataFrame, vertices: DataFrame, priority: Column | None = None, finish_arcs: int = FINISH_ARCS) -> DataFrame:
    """``id, color``: a proper colouring with at most the largest degree + 1 colours.

    A vertex whose neighbours of higher priority are all coloured takes the smallest colour that none of
    them has: the colouring that going through the vertices by descending priority would give. The
    priority (of ``id``) is a hash unless given; ties go to the larger id. Arcs must go both ways; self loops don't count.

    In a round all vertices that wait for none are coloured, and one task goes through the next ones by priority, as many as have
    ``finish_arcs`` arcs and used colours together. By the first alone rounds are as many as the longest descending path, which in a dense graph
    is about as long as its degrees; by both they are about the root of arcs / ``finish_arcs`` there. An arc is resolved in one round and then gone.
    """
    spark = arcs.sparkSession
    scratch = Scratch(spark, "coloring")
    weight = F.coalesce((F.xxhash64("id") if priority is None else priority).cast("long"), F.lit(-(1 << 63)))
    open_ = scratch.write(vertices.select("id", weight.alias("p")), "open")
    rank = F.struct("p", F.col("id").alias("i"))
    ends = arcs.filter("src <> dst").select("src", "dst").distinct()
    met = ends.join(open_.select(F.col("id").alias("src"), rank.alias("a")), "src").join(open_.select(F.col("id").alias("dst"), rank.alias("b")), "dst")
    waits = scratch.write(met.filter("b > a").select("src", "dst"), "waits")  # src waits for dst
    used = scratch.write(spark.createDataFrame([], "id long, color long"), "used")  # by coloured neighbours of open vertices
    done: list[DataFrame] = []

    def finished(run: DataFrame, resolved: DataFrame, name: str) -> DataFrame:
        """Colours of the vertices ``run``, worked out by one task; ``resolved`` (src, dst, color) are the arcs that they wait by."""
        by_arc = run.join(resolved.withColumnRenamed("src", "id"), "id", "left").select("id", "p", "dst", "color")
        by_color = run.join(used, "id").select("id", "p", F.lit(None).cast("long").alias("dst"), "color")
        return scratch.write(by_arc.unionByName(by_color).coalesce(1).mapInArrow(_finish, "id long, color long"), name)

    while not open_.isEmpty():
        if waits.count() + used.count() <= finish_arcs and open_.count() <= finish_arcs:
            done.append(finished(open_, waits.withColumn("color", F.lit(None).cast("long")), "done"))
            break
        missing = scratch.write(waits.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("missing")), "missing")
        ready = open_.join(missing, "id", "left_anti")
        seen = used.groupBy("id").agg(F.collect_set("color").alias("used"))
        taken = F.coalesce("used", F.array().cast("array<bigint>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(taken).cast("long")), taken))
        new = [scratch.write(ready.join(seen, "id", "left").select("id", free.alias("color")), "done")]
        held = used.groupBy("id").agg(F.count("*").alias("held"))
        rows = (F.col("missing") + F.coalesce("held", F.lit(0))).cast("long")
        order = [F.bitwise_not(c).alias(n) for c, n in ((F.col("p"), "down"), (F.col("id"), "low"))]
        waiting = open_.join(missing, "id").join(held, "id", "left").select("id", "p", *order, rows.alias("rows"))
        next_ = scratch.write(running_sum(waiting, ["down", "low"], "rows", "upto").filter(F.col("upto") <= finish_arcs).select("id", "p"), "next")
        if not next_.isEmpty():
            own = waits.join(next_.select(F.col("id").alias("src")), "src", "left_semi")
            new.append(finished(next_, own.join(new[0].withColumnRenamed("id", "dst"), "dst", "left"), "done"))
        colored = reduce(DataFrame.unionByName, new)
        before = open_, waits, used, missing, next_
        open_ = scratch.write(open_.join(colored, "id", "left_anti"), "open")
        left = waits.join(colored.select(F.col("id").alias("src")), "src", "left_anti")
        resolved = scratch.write(left.join(colored.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", "color"), "resolved")
        waits = scratch.write(resolved.filter("color is null").select("src", "dst"), "waits")
        mine = used.join(colored.select("id"), "id", "left_anti")
        used = scratch.write(mine.unionByName(resolved.filter("color is not null").select(F.col("src").alias("id"), "color")).distinct(), "used")
        scratch.drop(*before, resolved)
        done += new
        if len(done) >= PARTS:
            one = scratch.write(reduce(DataFrame.unionByName, done), "done")
            scratch.drop(*done)
            done = [one]
    scratch.drop(open_, waits, used)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "id long, color long")


def conflicts(arcs: DataFrame, colors: DataFrame) -> DataFrame:
    """One row: arcs between equal colours, and the number of colours."""
    a, b = colors.withColumnRenamed("id", "src").withColumnRenamed("color", "x"), colors.withColumnRenamed("id", "dst").withColumnRenamed("color", "y")
    clash = arcs.filter("src <> dst").join(a, "src").join(b, "dst").agg(F.count_if(F.col("x") == F.col("y")).alias("conflicts"))
    return clash.join(F.broadcast(colors.agg((F.max("color") + 1).alias("colors"))))


def color_order(colors: DataFrame) -> DataFrame:
    """Vertices by colour, then id."""
    return colors.orderBy("color", "id")


def relabel(arcs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Arcs with both ends renamed by ``mapping (id, idx)``."""
    a, b = mapping.select(F.col("id").alias("src"), F.col("idx").alias("s")), mapping.select(F.col("id").alias("dst"), F.col("idx").alias("d"))
    return arcs.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")
