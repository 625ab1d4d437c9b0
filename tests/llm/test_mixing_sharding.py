import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pairwright.llm.mixing import REST, mix_sources, mixed, pfair, phases, whole_weights
from pairwright.llm.sharding import part_of, shard_documents

SCHEMA = "doc_id long, source string, text string, slot string, __note int"


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = r.choice([None, "", "é" * r.randint(0, 40), "x" * r.randint(1, 900), "same text " * 9])
        out.append((i, r.choice(["a", "a", "a", "b", "c", None, "zz"]), text, "s", i))
    return out + [(5, "a", "twice", "s", 0)] * 3 + [(None, "b", None, None, None)] * 2


@pytest.mark.parametrize("weights", [[1], [3, 2, 1], [7, 1, 1, 5], [50, 1], [20 - i for i in range(20)] + [1]])
def test_pfair_keeps_within_a_block(weights):
    order, total = pfair(weights), sum(weights)
    assert Counter(order) == dict(enumerate(weights))
    for i, w in enumerate(weights):
        for t in range(1, total + 1):
            assert abs(order[:t].count(i) - Fraction(t * w, total)) < 1


def test_phases_are_the_step_by_step_schedule():
    weights, blocks = {"a": 3, "b": 2, "c": 4, "d": 1}, {"a": 20, "b": 40, "c": 3, "d": 0}
    left, used, want, slot = {k: v for k, v in blocks.items() if v}, Counter(), {}, 0
    while left:
        names = sorted(left)
        order, t = pfair([weights[n] for n in names]), 0
        while True:
            n = names[order[t % len(order)]]
            want[n, used[n]] = slot
            used[n] += 1
            left[n] -= 1
            slot, t = slot + 1, t + 1
            if not left[n]:
                del left[n]
                break
    got = {}
    for p in phases(weights, blocks):
        for b in range(p["first"], p["last"] + 1):
            got[p["source"], b] = p["base"] + (b - p["first"]) // p["weight"] * p["period"] + p["slots"][(b - p["first"]) % p["weight"]]
    assert got == want and sorted(got.values()) == list(range(63))


@pytest.mark.parametrize("weights,rest", [({"a": 150_000, "b": 1}, 1), ({"a": 0.1, "b": 0.25}, 0.65), ({"a": 1e-3, "b": 1 / 3}, 2)])
def test_weights_are_never_rounded(weights, rest):
    whole, given = whole_weights(weights, rest), {**weights, REST: rest}
    exact = {s: Fraction(str(x)) for s, x in given.items()}
    assert all(whole[s] * exact[t] == whole[t] * exact[s] for s in whole for t in whole)
    blocks = {"a": 4000, "b": 300, REST: 500}
    total, share = sum(exact.values()), {}
    plan = phases(whole, blocks)
    for p in plan:
        if p["base"]:
            continue
        for b in range(p["first"], p["last"] + 1):
            share[p["base"] + (b - p["first"]) // p["weight"] * p["period"] + p["slots"][(b - p["first"]) % p["weight"]]] = p["source"]
    seen = Counter()
    for t in range(len(share)):  # slots have no gap, and as long as all last each is within a block of its target
        seen[share[t]] += 1
        assert all(abs(seen[s] - (t + 1) * exact[s] / total) < 1 for s in given)
    assert max(seen[s] == n for s, n in blocks.items())
    assert sum(p["last"] - p["first"] + 1 for p in plan) == sum(blocks.values())


def test_weights_beyond_any_schedule_are_an_error():
    weights = whole_weights({"a": 1_500_001, "b": 1_000_003}, 1)
    assert phases(weights, {"a": 400, "b": 300, REST: 5})
    with pytest.raises(ValueError, match="period"):
        phases(weights, {"a": 4_000_000, "b": 300, REST: 5})
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            whole_weights({"a": bad}, 1)


def test_mix_blocks_and_order(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mix_sources(df, {"a": 5, "b": 2, "c": 1}, block_bytes=500).collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((x[0], x[2]) for x in rows())
    by = {}
    for x in got:
        assert x.mix_source == (x.source if x.source in ("a", "b", "c") else REST)
        by.setdefault(x.mix_source, []).append((x.mix_block * 500 + x.mix_offset, len((x.text or "").encode()) + 1))
    for stream in by.values():  # the streams have no gap
        at = 0
        for start, n in sorted(stream):
            assert start == at
            at += n
    slots = {(x.mix_source, x.mix_block): x.mix_slot for x in got}
    assert len(set(slots.values())) == len(slots)
    assert [x.doc_id for x in mixed(df, {"a": 5, "b": 2, "c": 1}, block_bytes=500).collect()] == [x.doc_id for x in sorted(got, key=lambda x: (x.mix_slot, x.mix_offset))]
    with pytest.raises(ValueError):
        mix_sources(df, {"a": 0})
    none = df.filter(F.lit(False))
    assert mix_sources(none, {"a": 1}).count() == 0 and mixed(none, {"a": 1}).columns == df.columns


@pytest.mark.parametrize("heavy_rows", [1, 20, 10**6])
def test_rows_that_repeat_are_numbered_in_groups_of_their_own(spark, monkeypatch, heavy_rows):
    """A third of the rows is one row over and over, another text has no id; some others share their cells."""
    monkeypatch.setattr("pairwright.llm.mixing.CELL_ROWS", 30)
    all_rows = [*rows(300), *[(7, "a", "over and over", "s", 1)] * 200, *[(None, "a", "no id", "s", 1)] * 90, *[(None, "b", None, "s", 1)] * 50]
    df = spark.createDataFrame(all_rows, SCHEMA).repartition(5)
    got = mix_sources(df, {"a": 5, "b": 2, "c": 1}, block_bytes=500, heavy_rows=heavy_rows).collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((x[0], x[2]) for x in all_rows) and len(got[0]) == len(df.columns) + 4
    order = {}
    for x in got:
        order.setdefault(x.mix_source, []).append((x.mix_block * 500 + x.mix_offset, len((x.text or "").encode()) + 1, hashlib.md5(f"{'' if x.doc_id is None else x.doc_id}:{hashlib.md5((x.text or '').encode()).hexdigest()}".encode()).hexdigest()[:15]))
    for stream in order.values():
        at = 0
        for start, n, _ in sorted(stream):
            assert start == at
            at += n
        assert [h for *_, h in sorted(stream)] == sorted(h for *_, h in stream)


def brute_shards(sizes_in_order, shards):
    total, start, out = sum(sizes_in_order), 0, []
    for n in sizes_in_order:
        out.append(min(shards - 1, start * shards // total))
        start += n
    return out


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards(spark, shards):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(shard_documents(df, shards).collect(), key=lambda x: (x.shard, x.slot))
    assert Counter((x.doc_id, x.text) for x in got) == Counter((x[0], x[2]) for x in rows())
    assert all(x["size"] == len((x.text or "").encode()) + 1 and x.text_crc32 == zlib.crc32((x.text or "").encode()) for x in got)
    assert [x.shard for x in got] == brute_shards([x["size"] for x in got], shards)
    for s in range(shards):
        assert [x.slot for x in got if x.shard == s] == list(range(sum(x.shard == s for x in got)))
    assert {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}
    assert len(got[0].asDict()) == len(df.columns) + 5


def test_many_shards_take_no_longer_expressions(spark):
    df = spark.createDataFrame([(i, "a", "t" * (i % 7), "", 0) for i in range(900)], SCHEMA)
    got = sorted(shard_documents(df, 700).collect(), key=lambda x: (x.shard, x.slot))
    assert [x.shard for x in got] == brute_shards([x["size"] for x in got], 700)
    points = [(i * 3, i % 5) for i in range(300)]
    keys = spark.createDataFrame([(k, g) for k in range(0, 910, 7) for g in range(6)], "k long, g long")
    found = keys.select("k", "g", part_of(points, ["k", "g"]).alias("p"))
    assert all(x.p == sum(p <= (x.k, x.g) for p in points) for x in found.collect())


def test_shards_of_copies_of_a_key_and_of_nothing(spark):
    df = spark.createDataFrame([(7, "a", "one and the same", "", 0)] * 333, SCHEMA)
    sizes = Counter(x.shard for x in shard_documents(df, 16).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    assert shard_documents(df.filter(F.lit(False))).count() == 0
    ordered = shard_documents(spark.createDataFrame(rows(), SCHEMA).filter("__note is not null"), 4, key=F.col("__note").cast("long")).collect()
    notes = [x["__note"] for x in sorted(ordered, key=lambda x: (x.shard, x.slot))]
    assert notes == sorted(notes)
    loose = shard_documents(spark.createDataFrame(rows(), SCHEMA), 4, tolerance=0.2)
    bytes_ = [x.b for x in loose.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(bytes_) < 1.3 * sum(bytes_) / 4
