import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pairwright.llm import simhash
from pairwright.llm.components import connected_components
from pairwright.llm.simhash import _forest, bits_apart, block_masks, blocks_for, close_links, cut_for, dedupe, near_groups, parities_apart, parity, similar_groups

SCHEMA = "doc_id long, text string, fp string, __note int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    low = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def texts(seed=3):
    r = random.Random(seed)
    words = [r.choice("abcdefgh") * r.randint(1, 5) + r.choice("Xyzü") for _ in range(80)]
    out = [None, "", "  \t\n", "one", "ONE", "two words", "Two  Words", "É é", "  x"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(3, 400))]
        out.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[r.randrange(len(near))] = r.choice(words)
            out.append(" ".join(near))
        out.append(" ".join(base))
    return out


def test_components_and_fingerprints_equal_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    got = {x.doc_id: x for x in near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    assert {i: x.fp % 2**64 for i, x in got.items()} == prints
    ids = list(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: x.component_id for i, x in got.items()} == brute_components(ids, linked)
    assert sorted(i for i, x in got.items() if x.rep) == sorted({x.component_id for x in got.values()})


def test_spark_hash_is_xxh64(spark):
    x = spark.sql("select xxhash64('a b cé ddddddddddddddddddddddddddddddddddddddd') h").first().h
    assert x % 2**64 == xxhash.xxh64_intdigest("a b cé ddddddddddddddddddddddddddddddddddddddd".encode(), 42)


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**10])
def test_close_pairs_share_a_masked_value(n):
    masks, r = block_masks(blocks_for(n)), random.Random(n)
    for _ in range(300):
        bits = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not bits & m for m in masks)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_hot_bucket_in_chunks(spark, chunk):
    r = random.Random(5)
    fps = sorted({sum(1 << b for b in r.sample(range(62), r.randint(0, 4))) for _ in range(300)})
    links = close_links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps), chunk=chunk).collect()
    brute = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert brute_components(fps, [(x.a, x.b) for x in links]) == brute


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_connected_components(spark, one_task):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    low = brute_components(sorted({x for e in edges for x in e}), edges)
    met = {x for a, b in edges if a != b for x in (a, b)}
    assert {x.node: x.component for x in connected_components(df, one_task).collect()} == {k: v for k, v in low.items() if k in met}


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed=5, bases=200):
    """Texts of many lengths, each with copies that differ in more and more words, and one group with a third of the rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = [None, "", " \t", "one", "two words", "one two", "One"]
    for b in range(bases):
        base = [r.choice(vocab) for _ in range(r.choice([6, 20, 60, 150, 400, 1500 if b % 20 == 0 else 100]))]
        out.append(" ".join(base))
        for changes in r.sample(range(1 + len(base) // 12), min(4, 1 + len(base) // 12)):
            near = list(base)
            for _ in range(changes):
                near[r.randrange(len(near))] = r.choice(vocab)
            out.append(" ".join(near).replace("w1", "W1"))
    big = [r.choice(vocab) for _ in range(200)]
    for _ in range(len(out) // 2):
        near = list(big)
        near[r.randrange(200)] = r.choice(vocab)
        out.append(" ".join(near))
    return list(enumerate(out))


def test_similar_texts_against_brute_force(spark):
    rows = planted()
    sets = {i: shingles(t) for i, t in rows}
    got = {x.doc_id: x for x in similar_groups(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()}
    alike = {(a, b): j for a in sets for b in sets if a < b and (j := jaccard(sets[a], sets[b])) > 0.1}
    together = lambda low, high: [got[a].component_id == got[b].component_id for (a, b), j in alike.items() if low <= j < high]
    assert all(together(1.0, 2)) and sum(together(0.9, 1)) >= 0.995 * len(together(0.9, 1)) > 100
    assert len(together(0.8, 0.9)) > 100 and sum(together(0.8, 0.9)) >= 0.95 * len(together(0.8, 0.9))
    low = brute_components(list(sets), [p for p, j in alike.items() if j >= 0.65])  # nobody is linked to what is not alike
    assert all(low[i] == low[x.component_id] for i, x in got.items())
    assert all(x.rep == (i == x.component_id) for i, x in got.items())
    kept = dedupe(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, x in got.items() if x.rep)


def test_all_links_at_the_similarity_and_no_others(spark):
    """Many pairs around 0.8, in a table with frequent lines: components equal those of an exact join."""
    r = random.Random(11)
    vocab, lines = [f"w{i}" for i in range(4000)], [" ".join(f"l{j}x{i}" for i in range(9)) for j in range(3)]
    out = [" ".join("abcdefghijklm"[:9]), " ".join("abcdefghijklm"[:8])]  # four of five shingles: 0.8
    for b in range(150):
        base = [r.choice(vocab) for _ in range(r.choice([30, 60, 120, 240]))]
        out.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(max(1, round(len(base) / r.uniform(35, 55)))):
                near[r.randrange(len(near))] = r.choice(vocab)
            out.append(" ".join(near))
    out += [f"{r.choice(lines)} {' '.join(r.choices(vocab, k=r.choice([1, 4, 40])))}" for _ in range(150)]
    sets = {i: shingles(t) for i, t in enumerate(out)}
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    close = [p for p in alike if jaccard(sets[p[0]], sets[p[1]]) < 0.83]
    got = {x.doc_id: x for x in similar_groups(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(out)], SCHEMA)).collect()}
    assert len(close) > 30 and {i: x.component_id for i, x in got.items()} == brute_components(list(sets), alike)


@pytest.mark.parametrize("chunk", [16, 1024])
def test_pairs_that_become_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, chunk):
    """300 near copies, most of them less alike than 0.8 but with first shingles in common: 44,850 pairs, of which few become rows."""
    r = random.Random(8)
    vocab, out = [f"w{i}" for i in range(5000)], []
    base = r.choices(vocab, k=200)
    for _ in range(300):
        near = list(base)
        for i in r.sample(range(200), r.randint(2, 6)):
            near[i] = r.choice(vocab)
        out.append(" ".join(near))
    rows, write = {}, simhash.Scratch.write

    def counted(self, df, name="t"):
        stored = write(self, df, name)
        if {"a", "b"} <= set(df.columns):
            rows[name] = max(rows.get(name, 0), stored.count())
        return stored

    monkeypatch.setattr(simhash.Scratch, "write", counted)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    sets = {i: shingles(t) for i, t in enumerate(out)}
    alike = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    got = {x.doc_id: x.component_id for x in similar_groups(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(out)], SCHEMA)).collect()}
    assert len(alike) > 1000 and got == brute_components(list(sets), alike) and len(set(got.values())) > 50
    assert max(rows.values()) <= 10 * len(out), rows


def test_first_shared_shingles_and_parities_leave_no_pair_out():
    """Sets of 3 to 20,000 shingles, their parities of several lengths, some shingles frequent: all pairs of components at the similarity pass, and few others."""
    r = np.random.default_rng(6)
    often = r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = []
    for n in [3, 5, 9, 30, 100, 230, 255, 258, 500, 1000, 1030, 2040, 2060, 4100, 9000, 20_000] * 3:
        base = np.unique(np.append(r.integers(0, 2**63, n, dtype=np.uint64), often[: n // 3]))
        sets.append(base)
        for _ in range(4):
            gone = r.random(len(base)) < r.uniform(0, 0.2)
            sets.append(np.unique(np.append(base[~gone], r.integers(0, 2**63, int(r.integers(0, 1 + len(base) // 10)), dtype=np.uint64))))
    component = [i if i % 5 else i - i % 3 for i in range(len(sets))]
    order = (np.sort(often), np.argsort(np.argsort(often[np.argsort(often)])) + 1)
    prefixes = [simhash.prefix_of(x, order, 0.8).tobytes() for x in sets]
    ids, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    units = 3
    dealt = next(simhash._deal(units, [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(component), pa.array(prefixes, pa.binary()), pa.array(sizes)], ["cls", "component", "prefix", "n"])]))
    met = pa.Table.from_batches(list(simhash._meet(0.8, units, [dealt.take(pa.array(np.argsort(dealt.column(0).to_numpy())))]))).to_pydict()
    short = [simhash.short_parity(parity(x).tobytes()) for x in sets]
    assert len({len(x) for x in short}) > 3
    cls = np.array(met["cls"])
    rows = pa.table({"unit": met["gram"], "cls": cls, "component": np.array(component)[cls], "n": sizes[cls], "place": met["place"], "side": np.full(len(cls), -1), "parity": pa.array([short[i] for i in cls], pa.binary())}).sort_by("unit")
    pairs = lambda nearest, size: {p for x in simhash._close(0.8, nearest, rows.to_batches(max_chunksize=size)) for p in zip(*x.to_pydict().values())}
    alike = {(a, b) for a in ids for b in ids if a < b and component[a] != component[b] and len(x := np.intersect1d(sets[a], sets[b])) >= 0.8 * (sizes[a] + sizes[b] - len(x)) - 1e-9}
    every, nearest = pairs(False, 10_000), pairs(True, 50)
    assert every == pairs(False, 50) and alike <= every and len(every) < 2 * len(alike) and len(alike) > 50
    assert nearest <= every and {i for p in nearest for i in p} == {i for p in every for i in p}


def test_parities_never_differ_in_more_than_the_sets():
    r = np.random.default_rng(4)
    for n in (1, 30, 1000, 1100, 2000, 9000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.append(x[: n - n // 9], r.integers(0, 2**63, n // 7, dtype=np.uint64)))
        z = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        assert parities_apart(parity(x).tobytes(), parity(y).tobytes()) <= len(np.setxor1d(x, y))
        assert n < 30 or parities_apart(parity(x).tobytes(), parity(z).tobytes()) > 2 * n / 9


def test_more_rows_take_longer_blocks_and_more_of_them():
    for n in (10, 5000, 10**6, 10**9):
        bits, blocks = cut_for(n)
        assert (1 - (1 - bits_apart(0.8)) ** bits) ** blocks <= 0.02 or not bits
        assert bits <= 40 and blocks <= 150 and bits * 2 <= 64


def test_forest_connects_what_all_pairs_connect():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, (3, 16), dtype=np.uint64)
    rows = np.concatenate([base[r.integers(0, 3, 900)] ^ (np.uint64(1) << r.integers(0, 64, (900, 16), dtype=np.uint64)), r.integers(0, 2**63, (700, 16), dtype=np.uint64)])
    rows = rows[r.permutation(len(rows))]
    a, b = _forest(rows, 60, 40)
    far = np.bitwise_count(rows[:, None, :] ^ rows[None]).sum(2)
    assert (far[a, b] <= 40).all() and len(a) < 64 * len(rows)
    x, y = np.nonzero(np.triu(far <= 40, 1))
    ids = list(range(len(rows)))
    assert brute_components(ids, list(zip(a.tolist(), b.tolist()))) == brute_components(ids, list(zip(x.tolist(), y.tolist())))


def test_empty_tables_nulls_and_repeats(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_groups(none).count() == 0 and dedupe(none).columns == none.columns
    rows = [(None, None, "a", 1), (None, "", "b", 2), (5, "a b c d", "c", 3), (5, "a b c d", "c", 4), (3, "A b c d", "d", None), (9, "q r s t u v", "e", 5)]
    got = near_groups(spark.createDataFrame(rows, SCHEMA))
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in got.collect()) == [(-1, -1), (-1, -1), (3, 3), (5, 3), (5, 3), (9, 9)]
    kept = dedupe(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "__note"]
    assert sorted((x.doc_id or -1) for x in kept.collect()) == [-1, 3, 9]
    assert similar_groups(none).count() == 0
    same = spark.createDataFrame([(5, "a b c d", "c", 3)] * 3, SCHEMA)
    assert dedupe(same).count() == 1
    assert dedupe(none.withColumn("x", F.lit(1))).count() == 0
