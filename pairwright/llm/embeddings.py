"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.components import connected_components, stars
from pairwright.llm.frames import table
from pairwright.plans.storage import Scratch

THRESHOLD = 0.95
BITS = 60
WINDOW = 48
SEED = 20
#: Vectors of a component that are compared in one unit of work.
CHUNK = 1024


def cell_bits(n: int, window: int = WINDOW) -> int:
    """So many leading bits of a key name a cell; of evenly spread vectors a cell then holds half a window."""
    return max(1, math.ceil(math.log2(max(2, 2 * n / window))))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = 0.02) -> int:
    """Passes after which a pair at the threshold has shared no cell with probability ``miss`` at most.

    A bit agrees with probability 1 - angle / pi, however the other vectors lie; how many rows
    share the cell does not matter, as the rows of a cell are all compared.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** cell_bits(n, window)
    return max(4, math.ceil(math.log(miss) / math.log(1 - agree)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose rows all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))


def _hash(passes: int, seed: int):
    @F.pandas_udf("array<long>")
    def of(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        dims = np.array([len(v) for v in vectors], dtype=int)
        weight = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for dim in np.unique(dims):
            planes, rows = _planes(int(dim), passes, seed), np.flatnonzero(dims == dim)
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                x = np.stack([vectors.iloc[i] for i in part]).astype(np.float64)
                keys = ((x @ planes > 0).reshape(len(part), passes, BITS) * weight).sum(2)
                for i, k in zip(part, keys):
                    out[i] = k
        return pd.Series(out)

    return of


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that neither tiny nor huge components under- or overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _windows(threshold: float, window: int, bits: int):
    """Over rows sorted by (pass, dim, key): compare each with the ``window`` rows before it. Rows
    without ``a`` and ``b`` name a task's first and last cell, which another task may hold a part of."""

    def cell(part, at):
        return [pa.array([x], t) for x, t in ((None, "int64"), (None, "int64"), (part["pass"][at].as_py(), "int32"), (part["dim"][at].as_py(), "int32"), (part["key"][at].as_py() >> (BITS - bits), "int64"))]

    def run(batches):
        rest, names = None, ["a", "b", "pass", "dim", "cell"]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(at, 4096)]).select(["pass", "dim", "key", "cls", "vec"])
                if rest is None:
                    yield pa.RecordBatch.from_arrays(cell(part, 0), names)
                part = part if rest is None else pa.concat_tables([rest, part])
                where = np.stack([part["pass"].to_numpy(), part["dim"].to_numpy()])
                ids, new = part["cls"].to_numpy(), 0 if rest is None else rest.num_rows
                found = []
                for one in np.unique(where, axis=1).T:
                    rows = np.flatnonzero((where == one[:, None]).all(0))
                    x = unit_rows(matrix(part["vec"].take(pa.array(rows))))
                    for d in range(1, min(window, len(rows) - 1) + 1):
                        near = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
                        near = near[rows[near + d] >= new]  # the other pairs were seen with the last slice
                        found.append(np.stack([ids[rows[near]], ids[rows[near + d]]]))
                if found and (pairs := np.concatenate(found, 1)).shape[1]:
                    star = stars(pairs[0], pairs[1])
                    yield pa.RecordBatch.from_arrays([*star.columns, *(pa.nulls(star.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64()))], names)
                rest = part.slice(max(0, part.num_rows - window)).combine_chunks()
        if rest is not None:
            yield pa.RecordBatch.from_arrays(cell(rest, -1), names)

    return run


def _by_unit(names: tuple[str, ...], emit):
    """Calls ``emit(rows, unit, starts)`` with whole units of rows that come sorted by ``names``."""

    def unit_of(t: pa.Table) -> np.ndarray:
        return np.array([t[c].to_numpy() for c in names])

    def whole(t: pa.Table):
        unit = unit_of(t)
        yield from emit(t, unit, np.flatnonzero(np.append(True, (unit[:, 1:] != unit[:, :-1]).any(0))))

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            if not t.num_rows:
                continue
            unit = unit_of(t)
            last = int(np.flatnonzero((unit != unit[:, -1:]).any(0)).max(initial=-1)) + 1
            if last:
                yield from whole(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from whole(rest)

    return run


def _within_cells(threshold: float):
    """Over rows sorted by unit: stars that link vectors of one cell whose components differ so far."""

    def emit(t: pa.Table, unit: np.ndarray, starts: np.ndarray):
        own, comp, cls = t["c"].to_numpy(), t["comp"].to_numpy(), t["cls"].to_numpy()
        for a, b in zip(starts, [*starts[1:], len(own)]):
            if (comp[a:b] == comp[a]).all():
                continue
            x, (i, j) = unit_rows(matrix(t["vec"].slice(a, b - a))), unit[-2:, a]
            left, right = np.flatnonzero(own[a:b] == i), np.flatnonzero(own[a:b] == j)
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                near = x[rows] @ x[right].T >= threshold
                near &= comp[a:b][rows][:, None] != comp[a:b][right][None, :]
                p, q = np.nonzero(near)
                if len(p):
                    yield stars(cls[a:b][rows[p]], cls[a:b][right[q]])

    return _by_unit(("pass", "dim", "cell", "i", "j"), emit)


def _count(threshold: float):
    """Over rows sorted by unit: each vector's links within its unit, counted with the copies of the other."""

    def emit(t: pa.Table, unit: np.ndarray, starts: np.ndarray):
        own, n, cls = t["c"].to_numpy(), t["n"].to_numpy(), t["cls"].to_numpy()
        total = np.zeros(len(own), np.int64)
        for a, b in zip(starts, [*starts[1:], len(own)]):
            x, (i, j) = unit_rows(matrix(t["vec"].slice(a, b - a))), unit[1:, a]
            left, right = np.flatnonzero(own[a:b] == i), np.flatnonzero(own[a:b] == j)
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                near = x[rows] @ x[right].T >= threshold
                near &= cls[a:b][rows][:, None] != cls[a:b][right][None, :]
                total[a + rows] += near @ n[a:b][right]
                if i != j:
                    total[a + right] += n[a:b][rows] @ near
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(total)], ["cls", "links"])

    return _by_unit(("comp", "i", "j"), emit)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Equal vectors are one class with a count. Each pass sorts all classes by the bits of random
    hyperplanes, joined to one key, and verifies each with its neighbours in a window; the union
    over the passes gives components. The number of passes follows from the number of vectors.
    Windows are bounded, so dense groups get an exact rest, in pairs of chunks and without emitting
    a pair: cells (rows whose keys begin alike) that are larger than a window, or lie on a border
    between tasks, are compared whole unless one component holds them already; and links are
    counted between all members of a component.

    Vectors that are null, zero, empty, or hold null or non-finite components link with nothing
    (0 links, a component of their own); so do vectors of different lengths with each other.
    Rows that repeat an id are rows of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    vec = F.col("vec")
    usable = vec.isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as they are; cosines are in double precision either way
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    good = rows.filter(F.coalesce(usable, F.lit(False)))
    bad = rows.filter(~F.coalesce(usable, F.lit(False)))
    grouped = good.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = scratch.write(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    passes = passes or passes_for(n, threshold, window)
    bits = cell_bits(n, window)
    # Stored with their keys: cutting them into ranges reads them twice, and cells once more.
    before, classes = classes, scratch.write(classes.select("*", F.size("vec").alias("dim"), _hash(passes, seed)("vec").alias("keys")), "classes")
    scratch.drop(before)
    key = F.posexplode("keys").alias("pass", "key")
    ordered = classes.select("cls", "vec", "dim", key).repartitionByRange("pass", "dim", "key", "cls").sortWithinPartitions("pass", "dim", "key", "cls")
    seen = scratch.write(ordered.mapInArrow(_windows(threshold, window, bits), "a long, b long, pass int, dim int, cell long").distinct(), "seen")
    near = scratch.write(connected_components(seen.select("a", "b")), "near")

    cell = ["pass", "dim", "cell"]
    cells = classes.select("cls", "dim", key).select("cls", "pass", "dim", F.shiftright("key", BITS - bits).alias("cell")).join(near.withColumnRenamed("node", "cls"), "cls", "left")
    cells = scratch.write(cells.select("cls", *cell, F.coalesce("component", "cls").alias("comp")), "cells")
    apart = cells.groupBy(*cell).agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    border = seen.filter("cell is not null").select(*cell, F.lit(True).alias("border")).distinct()
    whole = apart.join(F.broadcast(border), cell, "left").filter((F.col("size") > window + 1) | F.col("border")).select(*cell, F.ceil(F.col("size") / F.lit(chunk)).cast("int").alias("g"))
    met = cells.join(whole, cell).withColumn("c", F.pmod(F.xxhash64("cls"), "g").cast("int")).join(classes.select("cls", "vec"), "cls")
    other = F.expr("explode(transform(sequence(0, g - 1), x -> struct(least(c, x) as i, greatest(c, x) as j)))")
    units = met.select(*cell, "c", "cls", "comp", "vec", other.alias("o")).select(*cell, "o.i", "o.j", "c", "cls", "comp", "vec")
    dealt = units.repartition(*cell, "i", "j").sortWithinPartitions(*cell, "i", "j")
    more = scratch.write(dealt.mapInArrow(_within_cells(threshold), "a long, b long").distinct(), "more")
    found = scratch.write(connected_components(near.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)), "found")

    joined = scratch.write(classes.drop("dim", "keys").join(found.withColumnRenamed("node", "cls"), "cls").withColumnRenamed("component", "comp"), "joined")
    sizes = joined.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("g"), F.min("first").alias("low"))
    cut = joined.join(sizes, "comp").withColumn("c", F.pmod(F.xxhash64("cls"), "g").cast("int"))
    units = cut.select("comp", "c", "n", "cls", "vec", other.alias("o")).select("comp", "o.i", "o.j", "c", "n", "cls", "vec")
    dealt = units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    counted = dealt.mapInArrow(_count(threshold), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
    of = scratch.write(joined.join(sizes, "comp").join(counted, "cls").select("cls", "low", "links"), "of")
    scratch.drop(seen, near, cells, more, found, joined)

    # Copies meet their class again by the vector itself; a class with many copies is a skewed join that AQE splits.
    known = scratch.write(classes.join(of, "cls", "left").select("vec", "n", F.coalesce("low", "first").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    scratch.drop(classes, of)
    out = good.join(known, "vec").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = out.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, which is what the passes stand in for: on tables where recall is 1 the rows are equal.
SQL4 = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
ok as materialized (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
                    and len(list_filter(e, lambda x: x <> 0)) > 0),
p as materialized (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                   where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(x, y) as (select x, y from p union select r.x, p.y from r join p on r.y = p.x),
c as (select x, min(y) as low from r group by x), n as (select x, count(*) as n from p group by x)
select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join c on c.x = vec_id left join n on n.x = vec_id
"""
