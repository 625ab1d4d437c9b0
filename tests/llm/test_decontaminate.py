import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm.decontaminate import BLOCK_BYTES, decontaminate, find_matches, prepare, search, sorted_suffixes

DOCS, ITEMS = "doc_id long, text string, n_hit string", "item_id long, text string"


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        for j in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def data(seed=1):
    r = random.Random(seed)
    vocab = ["Ab", "c", "é", "d9", "日本", "x" * 30, "the", "of"]
    say = lambda n: " ".join(r.choice(vocab) + r.choice(["", ".", ",\n", "-"]) for _ in range(n))
    items = [(i, say(r.choice([12, 25, 40]))) for i in range(20)] + [(30, "zz short ITEM"), (31, "solo"), (32, None), (33, "..."), (2, say(11)), (None, say(14))]
    docs = [None, "", " . ", "nothing here", "zz short item zz", "solo, solo! so lo", "zz short"]
    for i in range(60):
        t = items[r.randrange(20)][1].split(" ")
        at = r.randrange(len(t))
        docs.append(say(r.randrange(40)) + " " + " ".join(t[at : at + r.randrange(20)]) + " " + say(r.randrange(30)))
    docs += [x[1] for x in items if x[1]] + [docs[9], docs[9], items[3][1] * 3]
    return [(i, t, "clash") for i, t in enumerate(docs)], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_equals_brute_force(spark, block_bytes):
    docs, items = data()
    found = find_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    got = {x.doc_id: x for x in found.collect()}
    for i, t, _ in docs:
        assert (got[i].n_words, got[i].n_hit, got[i].items) == brute(t, items), i
    clean = {x.doc_id for x in decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert clean == {i for i, t, _ in docs if not brute(t, items)[1]}


def test_shards_of_suffix_arrays(monkeypatch):
    monkeypatch.setattr("pairwright.llm.decontaminate.SHARD_WORDS", 60)
    docs, items = data()
    tests = prepare([(None if i is None else str(i), (t or "").encode()) for i, t in items])
    found = search([None if t is None else t.encode() for _, t, _ in docs], tests)
    for (_, t, _), (n, spans, names, _) in zip(docs, found):
        assert (n, int(spans[1::2].sum() - spans[::2].sum()), names) == brute(t, items)


def test_longest_match_and_locations(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "a b " + " ".join(f"w{i}" for i in range(5, 22)) + " c " + " ".join(f"w{i}" for i in range(12))
    x = find_matches(spark.createDataFrame([(1, doc, "")], DOCS), spark.createDataFrame([(7, item)], ITEMS)).first()
    assert (x.longest, x.n_words) == (17, 32) and x.spans == [2, 19, 20, 32] and x.items == ["7"] and x.n_hit == 29


def brute_longest(text, items):
    w, best = words(text), 0
    for _, t in items:
        x = words(t)
        for i in range(len(w)):
            for j in range(len(x)):
                n = 0
                while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                    n += 1
                best = max(best, n if n > 1 or len(x) == 1 else 0)
    return best


def test_longest_match_equals_brute_force():
    docs, items = data(3)
    docs.append((0, " ".join(["the"] * 70), ""))
    items.append((50, " ".join(["the"] * 43)))
    tests = prepare([(None if i is None else str(i), (t or "").encode()) for i, t in items])
    for (_, t, _), (*_, best) in zip(docs, search([None if t is None else t.encode() for _, t, _ in docs], tests)):
        assert best == brute_longest(t, items), t


def test_suffixes_are_sorted_to_their_ends():
    r = random.Random(4)
    texts = [[r.randint(1, 3) for _ in range(r.randint(1, 60))] for _ in range(30)] + [[1] * 50, [1] * 50]
    ids = np.array([x for t in texts for x in [*t, 0]] + [0] * 10, np.int32)
    suffix = lambda i: ids[i : i + list(ids[i:]).index(0)].tolist()
    got = [suffix(i) for i in sorted_suffixes(ids)]
    assert got == sorted(got) and len(got) == sum(map(len, texts))


def test_memory_of_a_block_and_of_many(spark):
    """32 MB of benchmark text of mostly different words: what the driver and a worker hold follows the block, not the benchmark."""
    r = random.Random(6)
    some = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    text = lambda n: " ".join(r.choices(some, k=n))
    block = [(str(i), text(600).encode()) for i in range(BLOCK_BYTES // 4500)]
    assert 0.8 * BLOCK_BYTES < sum(len(t) for _, t in block) < 1.2 * BLOCK_BYTES
    tracemalloc.start()
    tests = prepare(block)
    parts = tests.vocabulary, tests.suffixes, tests.windows, tests.heads
    found = search([block[3][1], b"nothing"], tests)
    peak = tracemalloc.get_traced_memory()[1]
    assert parts and found[0][1].tolist() == [0, 600] and found[0][3] == 600 and peak < 40 * BLOCK_BYTES
    items = [(i, text(600)) for i in range(7600)]
    docs = spark.createDataFrame([(1, "a " + items[17][1][200:400], ""), (2, "b " + items[7000][1], ""), (3, "none", "")], DOCS)
    frame = spark.createDataFrame(items, ITEMS)
    assert frame.agg(F.sum(F.length("text"))).first()[0] > 32e6
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found = find_matches(docs, frame)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    got = {x.doc_id: x for x in found.collect()}
    assert got[2].n_hit == 600 and got[2].items == ["7000"] and got[1].items == ["17"] and got[3].n_hit == 0
    assert peak < 40 * BLOCK_BYTES


def test_empty_tables(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert find_matches(d.filter(F.lit(False)), b).count() == 0
    assert find_matches(d, b.filter(F.lit(False))).filter("n_hit > 0").count() == 0
    assert decontaminate(d, b).columns == d.columns


def test_digest_of_no_item():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
