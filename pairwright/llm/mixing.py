"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.frames import sheltering, sheltering_also, table, without
from pairwright.llm.sharding import hash60
from pairwright.plans.storage import Scratch

BLOCK_BYTES = 64 << 10
#: Slots that one phase's period may have, where so many blocks are there at all: 8 MB of the broadcast schedule.
MOST_PERIOD = 1_000_000
#: Rows of a source that are numbered in one group, about.
CELL_ROWS = 2048
#: Rows with one hash (they repeat both id and text) beyond which these are numbered in groups of their own.
HEAVY_ROWS = 16 * CELL_ROWS
REST = "(rest)"
OWN = ["mix_source", "mix_block", "mix_slot", "mix_offset"]
WEIGHTS = {f"src{i}": 20 - i for i in range(20)}


def pfair(weights: list[int], slots: int | None = None) -> list[int]:
    """Which source each slot of one period goes to, or of its first ``slots``.

    Block j of source i (from 0) is released at floor(j * Q / w) and due at ceil((j + 1) * Q / w), Q being
    the sum of the weights. Each slot takes the released block that is due first, of equal ones that of
    the first source. Every block then meets its due time, so after t slots a source has had t * w / Q
    blocks but for less than one, and the period repeats after Q slots.
    """
    period = sum(weights)
    due: list[tuple[int, int]] = []
    release = [(0, i) for i in range(len(weights))]
    count, out = [0] * len(weights), []
    for slot in range(period if slots is None else min(slots, period)):
        while release and release[0][0] <= slot:
            _, i = heapq.heappop(release)
            heapq.heappush(due, (-(-(count[i] + 1) * period // weights[i]), i))
        _, i = heapq.heappop(due)
        out.append(i)
        count[i] += 1
        heapq.heappush(release, (count[i] * period // weights[i], i))
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """Closed form of the whole schedule: while a set of sources lasts, its period repeats; when one has
    given its last block, the others go on by their weights among themselves.

    A row per source and phase: block b in [first, last] goes to slot base + (b - first) // w * period + slots[(b - first) % w].
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    first, base, out = dict.fromkeys(left, 0), 0, []
    while left:
        names = sorted(left)
        common = math.gcd(*(weights[s] for s in names))
        w = [weights[s] // common for s in names]
        period, total = sum(w), sum(left.values())
        if min(period, total) > MOST_PERIOD:
            raise ValueError(f"the weights of {names} need a period of {period} slots; at most {MOST_PERIOD} can be scheduled")
        slots: list[list[int]] = [[] for _ in names]
        for slot, i in enumerate(pfair(w, total)):  # no more of a period than there are blocks
            slots[i].append(slot)
        # The slot behind a source's last block; in a part of a period a source may not come to it.
        ends = [(left[s] - 1) // w[i] * period + slots[i][(left[s] - 1) % w[i]] + 1 for i, s in enumerate(names) if (left[s] - 1) % w[i] < len(slots[i])]
        length = min(ends)
        for i, s in enumerate(names):
            n = length // period * w[i] + bisect_left(slots[i], length % period)
            if n:
                out.append({"source": s, "first": first[s], "last": first[s] + n - 1, "base": base, "period": period, "weight": w[i], "slots": slots[i]})
            first[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base += length
    return out


def whole_weights(weights: dict[str, float], rest: float) -> dict[str, int]:
    """The same ratios as the smallest whole numbers. A fraction is what its shortest decimal says (0.1 is a tenth); none is
    ever rounded. Weights must be above zero and finite."""
    given = {**weights, REST: rest}
    if any(not 0 < x < math.inf for x in given.values()):
        raise ValueError("weights must be above zero")
    exact = {s: Fraction(str(x)) for s, x in given.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: x // common for s, x in whole.items()}


@sheltering
def mix_sources(docs: DataFrame, weights: dict[str, float], rest: float = 1, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``docs`` with ``mix_source, mix_block, mix_slot, mix_offset``, which replace columns of those names.

    Each source's rows, in a random but fixed order, are a stream of bytes (text and one more a row) cut
    into blocks of ``block_bytes``; a row is in the block that its first byte is in. Blocks of all
    sources share the slots as :func:`pfair` and :func:`phases` say, so at every slot each source is less
    than one block from its target for as long as all last. No row is dropped or repeated. Sorting
    by ``mix_slot, mix_offset`` gives the mixture. Sources that ``weights`` does not name, null too,
    are one source with weight ``rest``. Weights count exactly; ratios that would need a period of more than a
    million slots, in a table of more blocks than that, are an error.

    A hot source is no group of its own: its rows are numbered in cells of a hash, and the cells' sums
    come first. Nor are rows that repeat id and text (or a text without an id): where they are more than ``heavy_rows``, they
    are dealt to groups by their place in the input. The schedule is a table of at most (sources + 1) squared rows, of a size that the
    weights bound and not the data. Null texts count as empty; rows that repeat id and text follow each
    other; an empty table gives an empty result.
    """
    weights = whole_weights(weights, rest)
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    own = without(docs, *OWN)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.col(source_col).isin(*[s for s in weights if s != REST])
    rows = own.select(
        *own.columns,
        F.when(named, F.col(source_col)).otherwise(REST).alias("mix_source"),
        (F.octet_length(text) + 1).cast("long").alias("__n"),
        hash60(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))).alias("__h"),
        F.monotonically_increasing_id().alias("__m"),
    )
    # Hashes of 60 bits: the first 12 name an upper cell, and as many as make cells small a cell.
    upper = scratch.write(rows.groupBy("mix_source", F.shiftright("__h", 36).alias("__c")).agg(F.sum("__n").alias("n"), F.count("*").alias("rows")), "cells")
    total = upper.agg(F.sum("rows")).first()[0] or 0
    bits = min(24, max(0, (total // CELL_ROWS).bit_length()))
    merged = upper.groupBy("mix_source", F.shiftright("__c", 24 - bits).alias("__cell")).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    keyed = rows.withColumn("__cell", F.shiftright("__h", 60 - bits))
    full = scratch.write(merged.filter(F.col("rows") > heavy_rows).select("mix_source", "__cell"), "full")
    inside = _plain(keyed) if full.isEmpty() else _by_heavy(keyed, full, heavy_rows, scratch)
    merged = merged.withColumn("top", F.shiftright("__cell", max(0, bits - 12)))
    tops = merged.groupBy("mix_source", "top").agg(F.sum("n").alias("n"))
    return _place(inside, merged, tops, weights, block_bytes, own.columns, scratch)


def _before(keys: list[str], order: list[str], value: str = "n") -> Column:
    """Sum of a column over the rows before, in an order within groups."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _plain(keyed: DataFrame) -> DataFrame:
    """``__in``: the bytes of a row's cell before it."""
    return keyed.withColumn("__in", _before(["mix_source", "__cell"], ["__h"], "__n")).drop("__m")


def _by_heavy(keyed: DataFrame, full: DataFrame, heavy_rows: int, scratch: Scratch) -> DataFrame:
    """The same where some hashes have very many rows: these are numbered in parts, and the others of the cell around them.

    A heavy hash has over ``heavy_rows`` rows, so their list is that much shorter than the table; a cell's entries are one array.
    """
    cell = ["mix_source", "__cell"]
    there = keyed.select(*cell, "__h", "__n").join(F.broadcast(full), cell)
    counts = scratch.write(there.groupBy(*cell, "__h").agg(F.count("*").alias("rows"), F.sum("__n").alias("n")), "counts")
    heavy = counts.filter(F.col("rows") > heavy_rows)
    light = F.col("l.__h") < F.col("k.__h")
    lights = heavy.alias("k").join(counts.filter(F.col("rows") <= heavy_rows).alias("l"), [F.col(f"k.{c}") == F.col(f"l.{c}") for c in cell] + [light], "left")
    lights = lights.groupBy("k.mix_source", "k.__cell", "k.__h", "k.rows", "k.n").agg(F.coalesce(F.sum("l.n"), F.lit(0)).alias("light"))
    entry = F.struct("__h", "n", "light", F.ceil(F.col("rows") / F.lit(CELL_ROWS)).cast("int").alias("parts"))
    lists = scratch.write(lights.groupBy(*cell).agg(F.collect_list(entry).alias("__list")), "lists")
    met = keyed.join(F.broadcast(lists), cell, "left")
    mine = F.get(F.filter("__list", lambda x: x["__h"] == F.col("__h")), F.lit(0))
    met = met.withColumn("__mine", mine).withColumn("__ahead", F.coalesce(F.aggregate(F.filter("__list", lambda x: x["__h"] < F.col("__h")), F.lit(0).cast("long"), lambda n, x: n + x["n"]), F.lit(0)))
    met = met.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__m"), F.col("__mine.parts")), F.lit(-1))).withColumn("__own", F.when(F.col("__mine").isNotNull(), F.col("__h")).otherwise(-1))
    group = [*cell, "__own", "__part"]
    # Places in the input may come out otherwise a second time, so the rows that are dealt by them are stored with them.
    dealt = scratch.write(met.filter("__part >= 0"), "dealt")
    sums = dealt.groupBy(*group).agg(F.sum("__n").alias("n"))
    sums = sums.select(*group, _before([*cell, "__own"], ["__part"]).alias("__parts_before"))
    start = _before(group, ["__h", "__m"], "__n") + F.col("__ahead")
    out = dealt.withColumn("__in", start + F.col("__mine.light")).join(sums, group).withColumn("__in", F.col("__in") + F.col("__parts_before"))
    others = met.filter("__part < 0").withColumn("__in", start)
    return others.unionByName(out.drop("__parts_before")).drop("__m", "__list", "__mine", "__ahead", "__part", "__own")


def _place(inside, merged, tops, weights, block_bytes, columns, scratch):
    spark = inside.sparkSession
    tops = tops.select("mix_source", "top", _before(["mix_source"], ["top"]).alias("over"))
    offsets = merged.withColumn("inside", _before(["mix_source", "top"], ["__cell"])).join(tops, ["mix_source", "top"])
    offsets = scratch.write(offsets.select("mix_source", "__cell", "n", (F.col("over") + F.col("inside")).alias("__before")), "offsets")
    blocks = {x.mix_source: -(-x.n // block_bytes) for x in offsets.groupBy("mix_source").agg(F.sum("n").alias("n")).collect()}  # a row a named source
    plan = spark.createDataFrame(
        [(p["source"], p["first"], p["last"], p["base"], p["period"], p["weight"], p["slots"]) for p in phases(weights, blocks)],
        "__s string, __first long, __last long, __base long, __period long, __weight long, __slots array<long>",
    )
    placed = inside.join(offsets.drop("n"), ["mix_source", "__cell"]).withColumn("__start", F.col("__in") + F.col("__before"))
    placed = placed.withColumn("mix_block", F.expr(f"__start div {block_bytes}L"))
    met = placed.join(F.broadcast(plan), (F.col("mix_source") == F.col("__s")) & F.col("mix_block").between(F.col("__first"), F.col("__last")))
    step = F.col("mix_block") - F.col("__first")
    slot = F.col("__base") + F.expr("(mix_block - __first) div __weight") * F.col("__period") + F.element_at("__slots", (F.pmod(step, F.col("__weight")) + 1).cast("int"))
    return met.select(*columns, "mix_source", "mix_block", slot.alias("mix_slot"), (F.col("__start") - F.col("mix_block") * block_bytes).alias("mix_offset"))


@sheltering_also(*OWN)
def mixed(docs: DataFrame, weights: dict[str, float], **more) -> DataFrame:
    """``docs``, all of it, sorted into the mixture. Null texts, ids and sources, repeated rows and an empty table are
    as in :func:`mix_sources`; columns of any name stay."""
    return mix_sources(docs, weights, **more).orderBy("mix_slot", "mix_offset").select(*docs.columns)


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, WEIGHTS).select("doc_id", *OWN)


SQL1 = f"""
with recursive w(s, a) as (values {', '.join(f"('{s}', {a})" for s, a in WEIGHTS.items())}, ('{REST}', 1)),
d as (select doc_id, coalesce((select s from w where s = source and s <> '{REST}'), '{REST}') as s, strlen(coalesce(text, '')) + 1 as n,
             md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))) as h from documents),
p as (select *, sum(n) over (partition by s order by substr(h, 1, 15) rows unbounded preceding) - n as start from d),
q as (select *, start // {BLOCK_BYTES} as b from p),
t as (select s, (sum(n) + {BLOCK_BYTES - 1}) // {BLOCK_BYTES} as blocks from d group by s),
l as (select list(s order by s) as ss, list(cast(a as bigint) order by s) as a, list(cast(blocks as bigint) order by s) as b from t join w using (s)),
r as (select cast(0 as bigint) as t, cast(0 as bigint) as t0, list_transform(a, lambda x: cast(0 as bigint)) as c,
             list_transform(a, lambda x: cast(0 as bigint)) as u, cast(0 as bigint) as pick, cast(-1 as bigint) as blk from l
      union all
      select t + 1, case when u[i] + 1 = b[i] then t + 1 else t0 end,
             list_transform(c, lambda x, j: case when u[i] + 1 = b[i] then 0 when j = i then x + 1 else x end),
             list_transform(u, lambda x, j: case when j = i then x + 1 else x end), i, u[i]
      from (select *, list_min(list_filter(list_transform(range(1, len(a) + 1), lambda j: case
                        when u[j] < b[j] and c[j] * q // a[j] <= t - t0 then [(((c[j] + 1) * q + a[j] - 1) // a[j]), j] end), lambda x: x is not null))[2] as i
            from (select r.*, a, b, cast(list_sum(list_transform(a, lambda x, j: case when u[j] < b[j] then x else 0 end)) as bigint) as q
                  from r, l where list_sum(u) < list_sum(b)) as one) as two),
slots as (select ss[pick] as s, blk as b, t - 1 as slot from r, l where pick > 0)
select doc_id, q.s as mix_source, cast(q.b as bigint) as mix_block, cast(slot as bigint) as mix_slot,
       cast(start - q.b * {BLOCK_BYTES} as bigint) as mix_offset
from q join slots on q.s = slots.s and q.b = slots.b
"""
