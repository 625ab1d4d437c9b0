"""Sharding by histogram sort, with DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.frames import sheltering, table, without
from pairwright.plans.storage import Scratch

SHARDS = 16
#: Probes that a round spreads over each open interval.
PROBES = 4096
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def hash60(text: Column) -> Column:
    """The first 60 bits of an MD5 as a long, in an order that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Cut:
    """Where a splitter may still lie: rows whose first key columns equal ``prefix`` and whose next one is in [low, high)."""

    target: int
    prefix: tuple
    low: int
    high: int
    below: int  # bytes of all rows before this interval
    done: bool = False

    def point(self) -> tuple:
        return (*self.prefix, self.low)


def splitters(keys: DataFrame, levels: list[str], weight: str, parts: int, tolerance: float = 0.0) -> list[tuple]:
    """Keys that split ``keys`` into ``parts`` ranges of near equal weight.

    Histogram sort: each round counts the exact weight below probes in the open interval of every
    splitter, and keeps the interval between two probes that holds the target. A splitter is
    found when the interval holds one row or at most ``tolerance`` of a part. Where one value of a
    key column holds too much, the search goes on with the next column. The driver sees at most
    parts * PROBES sums a round. A row belongs to the part whose range its first byte is in.
    """
    spread = keys.agg(F.sum(weight).alias("total"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(levels) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = spread.total or 0
    if not total:
        return []
    ends = [(spread[f"lo{i}"], spread[f"hi{i}"] + 1) for i in range(len(levels))]
    cuts = [Cut(-(-i * total // parts), (), *ends[0], 0) for i in range(1, parts)]
    near = tolerance * total / parts
    row = F.struct(*levels)
    while open_ := sorted({(c.prefix, c.low, c.high) for c in cuts if not c.done}):
        # Intervals don't overlap, so a row can only be in the last one that begins at or before it.
        open_.sort(key=lambda x: _whole((*x[0], x[1]), len(levels)))
        widths = [max(1, -(-(high - low) // PROBES)) for _, low, high in open_]
        place = _at_or_below(row, [_whole((*p, low), len(levels)) for p, low, _ in open_], levels)
        given = [*[[(p[i] if i < len(p) else 0) for p, _, _ in open_] for i in range(len(levels) - 1)], [len(p) for p, _, _ in open_], [low for _, low, _ in open_], [high for _, _, high in open_], widths]
        *prefix, depth, low, high, width = [F.get(F.lit(x).cast("array<bigint>"), F.col("r")) for x in given]
        own = F.get(F.array(*levels), depth.cast("int"))
        inside = own < high
        for i, value in enumerate(prefix):
            inside &= (depth <= i) | (F.col(levels[i]) == value)
        met = keys.withColumn("r", place - 1).filter(inside)  # before the first interval all of these are null
        cells = met.select("r", (own - low).alias("x"), width.alias("w"), F.col(weight).alias("weight")).groupBy("r", F.expr("x div w").alias("p")).agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
        got: dict[int, list] = {}
        for x in cells.collect():
            got.setdefault(x.r, []).append((x.p, x.s, x.n))
        number = {x: i for i, x in enumerate(open_)}
        cuts = [c if c.done else _narrow(c, sorted(got[r := number[c.prefix, c.low, c.high]]), widths[r], ends, near) for c in cuts]
    return [c.point() for c in cuts]


def _whole(point: tuple, levels: int) -> tuple:
    """A key that is given by its first columns, as the smallest whole key that begins so; keys are not negative."""
    return (*point, *[0] * (levels - len(point)))


def _at_or_below(row: Column, points: list[tuple], levels: list[str]) -> Column:
    """How many of the sorted ``points`` are at or below a row: a binary search in a constant array, so that neither the
    expression nor the work for a row grows with the number of points but by a logarithm."""
    if not points:
        return F.lit(0)
    sorted_ = F.arrays_zip(*[F.lit([p[i] for p in points]).cast("array<bigint>").alias(c) for i, c in enumerate(levels)])

    def step(at: Column, _: Column) -> Column:
        mid = F.shiftright(at.low + at.high, 1)
        below = F.element_at(sorted_, mid + 1) <= row
        on = at.low < at.high
        return F.struct(F.when(on & below, mid + 1).otherwise(at.low).alias("low"), F.when(on & ~below, mid).otherwise(at.high).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(points)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(points).bit_length())), begin, step, lambda at: at.low)


def _narrow(cut: Cut, cells: list[tuple[int, int, int]], width: int, ends: list, near: float) -> Cut:
    sums, below = [], cut.below
    for _, w, _ in cells:
        below += w
        sums.append(below)
    at = bisect_left(sums, cut.target)  # the first cell that reaches the target
    p, w, n = cells[at]
    before = sums[at] - w
    low, high = cut.low + p * width, min(cut.high, cut.low + (p + 1) * width)
    if n == 1 or w <= near:
        to_low = n > 1 and cut.target - before < sums[at] - cut.target
        return replace(cut, low=low if to_low else high, done=True)
    if width > 1:
        return replace(cut, low=low, high=high, below=before)
    level = len(cut.prefix) + 1
    if level == len(ends):
        return replace(cut, low=high, done=True)
    return replace(cut, prefix=(*cut.prefix, low), low=ends[level][0], high=ends[level][1], below=before)


def part_of(points: list[tuple], levels: list[str]) -> Column:
    """How many of the splitters a row is at or beyond."""
    return _at_or_below(F.struct(*levels), [_whole(p, len(levels)) for p in points], levels).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, tolerance: float = 0.0, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``, which replace columns of those names.

    Law ``bytes``: rows in the order of ``key`` (a non-negative long; by default a hash of the text, so
    that equal texts stand together), then of a hash of the id, are cut into shards of near equal size;
    a row goes to the shard that its first byte falls into. A group of equal texts is cut only where a
    border must fall into it. ``slot`` numbers the rows of a shard in that order.

    The splitters come from :func:`splitters` over a table of keys; then the rows are exchanged once, by
    range, and slots follow from counts per partition. Null texts have size 1 like empty ones; rows that
    repeat both id and text are told apart by their place in the input. An empty table gives an empty result.
    Without ``keep_text`` the texts are measured but neither exchanged nor returned.
    """
    if key is None:
        return _shard(docs, shards, id_col, text_col, None, tolerance, keep_text)
    place = "place"
    while place in {c.lower() for c in docs.columns}:
        place += "_"
    return _shard(docs.withColumn(place, key), shards, id_col, text_col, place, tolerance, keep_text).drop(place)


@sheltering
def _shard(docs: DataFrame, shards: int, id_col: str, text_col: str, place: str | None, tolerance: float, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = without(docs, *OWN)
    levels = ["__k", "__g", "__m"]
    rows = rest.select(
        *[F.col(c) for c in rest.columns],
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (hash60(text) if place is None else F.col(place)).alias("__k"),
        hash60(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__g"),
        F.monotonically_increasing_id().alias("__m"),
    )
    keys = scratch.write(rows.select("size", *levels), "keys")
    if not keep_text:
        rows = rows.drop(text_col)
    columns = [c for c in rest.columns if keep_text or c != text_col]
    points = splitters(keys, levels, "size", shards, tolerance)
    scratch.drop(keys)
    dealt = rows.withColumn("shard", part_of(points, levels)).repartitionByRange("shard", *levels).sortWithinPartitions("shard", *levels)
    placed = scratch.write(dealt.drop(*levels).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "placed")
    runs = placed.groupBy("__p", "shard").agg(F.count("*").alias("n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a partition and shard, and partitions are ranges of shards: at most partitions + shards rows.
    runs = F.broadcast(runs.select("__p", "shard", "__first", before.alias("__before")))
    out = placed.join(runs, ["__p", "shard"]).withColumn("slot", F.col("__i") - F.col("__first") + F.col("__before"))
    return out.select(*columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, keep_text=False).select("doc_id", *OWN)


SQL7 = """
with tab as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
k as (select doc_id, strlen(coalesce(text, '')) + 1 as size, hex(encode(coalesce(text, ''))) as x,
             cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as k,
             cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as g from documents),
c as (select *, sum(size) over (order by k, g rows unbounded preceding) - size as start, sum(size) over () as total from k),
s as (select *, cast(least(15, (start * 16) // total) as int) as shard from c)
select doc_id, cast(size as bigint) as size, 'bytes' as law, shard,
       case when x = '' then 0 else xor(4294967295, list_reduce(
           list_prepend(cast(4294967295 as bigint), list_transform(range(1, len(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))),
           lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]))) end as text_crc32,
       row_number() over (partition by shard order by k, g) - 1 as slot, cast(null as int) as grown_shard from s, tab
"""
