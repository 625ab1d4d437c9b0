import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import matching
from pairwright.operators.graph import arcs_of, asymmetric, canonical, checked, csr_offsets, dense_ids, running_sum
from pairwright.operators.matching import eligible, locally_dominant, mate_weights, mutual, pointers, still_valid

GOLDEN = [(0, 1, 0.1), (0, 2, 5.1), (1, 2, 3.1), (1, 3, 2.1), (1, 4, 1.1), (2, 3, 4.1), (3, 5, 7.2), (4, 5, 3.2)]
NAN = float("nan")
CASES = {
    "tri_equal": ([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)], {(1, 2)}),
    "k4_equal": ([(a, b, 1.0) for a, b in itertools.combinations(range(4), 2)], {(2, 3), (0, 1)}),
    "path4_asc": ([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0)], {(2, 3), (0, 1)}),
    "path12_asc": ([(i, i + 1, i + 1.0) for i in range(11)], {(i, i + 1) for i in range(0, 11, 2)}),
    "star_equal": ([(0, i, 5.0) for i in range(1, 5)], {(0, 4)}),
    "neg_one": ([(0, 1, -1.0)], {(0, 1)}),
    "neg_1_5": ([(0, 1, -1.5)], set()),
    "zero": ([(0, 1, 0.0)], {(0, 1)}),
    "nan": ([(0, 1, NAN)], set()),
    "self_loop": ([(0, 0, 9.0), (0, 1, 1.0)], {(0, 1)}),
    "empty": ([], set()),
}


def edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double").repartition(3)


def greedy(rows):
    taken, out = set(), set()
    for w, b, a in sorted(((w, max(a, b), min(a, b)) for a, b, w in rows if a != b and w >= -1), reverse=True):
        if not {a, b} & taken:
            taken |= {a, b}
            out.add((a, b))
    return out


def round_count(rows):
    """Rounds of pointers and mutual pairs, step by step."""
    live, n = [(a, b, w) for a, b, w in rows if a != b and w >= -1], 0
    while live:
        best = {}
        for a, b, w in live:
            for x, y in ((a, b), (b, a)):
                best[x] = max(best.get(x, (w, y)), (w, y))
        gone = {x for x, (_, y) in best.items() if best[y][1] == x}
        live, n = [e for e in live if not {e[0], e[1]} & gone], n + 1
    return n


def pairs(m):
    return {(x.u, x.v) for x in m.pairs.collect()}


@pytest.mark.parametrize("finish", [0, 10**6])
def test_golden(spark, finish):
    m = locally_dominant(edges(spark, GOLDEN), finish_edges=finish)
    assert pairs(m) == {(0, 2), (1, 4), (3, 5)}
    x = m.summary().first()
    assert (x.matched_vertices, x.pairs, round(x.matching_weight, 9), round(x.both_ends_weight, 9)) == (6, 3, 13.4, 26.8)
    assert m.rounds == 2
    assert {(x.u, x.v) for x in m.mates().collect()} == {(0, 2), (2, 0), (1, 4), (4, 1), (3, 5), (5, 3)}


@pytest.mark.parametrize("name", ["tri_equal", "k4_equal", "path4_asc", "star_equal", "neg_one", "neg_1_5", "nan", "self_loop", "empty"])
def test_cases_by_rounds(spark, name):
    rows, want = CASES[name]
    assert pairs(locally_dominant(edges(spark, rows), finish_edges=0)) == want


@pytest.mark.parametrize("name", list(CASES))
def test_cases_in_one_task(spark, name):
    rows, want = CASES[name]
    assert pairs(locally_dominant(edges(spark, rows))) == want == greedy(rows)


def test_positive_only(spark):
    assert pairs(locally_dominant(edges(spark, CASES["zero"][0]), 0.0, strict=True)) == set()


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_ties(spark, seed):
    r = random.Random(seed)
    found = {tuple(sorted(r.sample(range(40), 2))) for _ in range(150)}
    rows = [(a, b, r.choice([-1.0, -0.5, 0.0, 1.0, 2.0])) for a, b in found]
    m = locally_dominant(edges(spark, rows), finish_edges=0)
    got = pairs(m)
    assert m.rounds == locally_dominant(edges(spark, rows)).rounds == round_count(rows)
    assert got == greedy(rows) == pairs(locally_dominant(edges(spark, rows).repartition(7)))
    met = {x for p in got for x in p}
    assert len(met) == 2 * len(got) and all({a, b} & met for a, b, _ in rows)


@pytest.mark.parametrize("rounds", [0, 2, 40])
def test_the_finish_of_one_task(monkeypatch, rounds):
    monkeypatch.setattr(matching, "TASK_ROUNDS", rounds)
    r = random.Random(rounds)
    for n in (2, 5, 30, 200):
        found = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(3 * n)})
        rows = [(*(p if r.random() < 0.5 else p[::-1]), r.choice([0.0, 1.0, 2.5])) for p in found]
        u, v, w = (np.array(c) for c in zip(*rows))
        keep, n_rounds = matching.greedy(u, v, w)
        assert n_rounds == round_count(rows)
        assert {(min(u[i], v[i]), max(u[i], v[i])) for i in keep.tolist()} == greedy(rows) and len(keep) == len(greedy(rows))
    path = np.arange(5000)
    keep, n_rounds = matching.greedy(path, path + 1, path.astype(float))
    assert len(keep) == 2500 == n_rounds


def test_half_of_the_optimum():
    r = random.Random(5)
    for _ in range(40):
        rows = [(a, b, r.random()) for a, b in itertools.combinations(range(7), 2) if r.random() < 0.6]
        weight = {(a, b): w for a, b, w in rows}

        def best(free):
            if len(free) < 2:
                return 0
            a, rest = free[0], free[1:]
            return max([best(rest), *(weight.get((a, b), 0) + best([x for x in rest if x != b]) for b in rest)])

        assert 2 * sum(weight[p] for p in greedy(rows)) >= best(list(range(7))) - 1e-9


def test_parallel_and_asymmetric_arcs(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 0, 4.0), (1, 2, 3.0), (2, 1, 3.0), (2, 2, 9.0), (3, None, 1.0), (0, 3, NAN)], "src long, dst long, w double")
    assert {(x.u, x.v, x.w) for x in canonical(arcs).collect()} == {(0, 1, 4.0), (1, 2, 3.0)}
    assert pairs(locally_dominant(canonical(arcs))) == {(0, 1)}
    with pytest.raises(ValueError):
        checked(arcs)
    fine = arcs_of(edges(spark, GOLDEN))
    assert asymmetric(fine).count() == 0 and checked(fine).count() == 8


def test_one_round(spark):
    arcs = arcs_of(eligible(edges(spark, GOLDEN)))
    assert {(x.u, x.p) for x in pointers(arcs).collect()} == {(0, 2), (1, 2), (2, 0), (3, 5), (4, 5), (5, 3)}
    once = mutual(pointers(arcs))
    assert {(x.u, x.v) for x in once.collect()} == {(0, 2), (3, 5)}
    gone = once.select(F.explode(F.array("u", "v")).alias("id"))
    assert {(x.u, x.p, x.valid) for x in still_valid(pointers(arcs), gone).collect()} == {(1, 2, False), (4, 5, False)}
    assert {(x.u, x.v, x.w) for x in mate_weights(once, arcs).collect()} == {(0, 2, 5.1), (3, 5, 7.2)}


def test_offsets_and_prefix_sums(spark):
    got = csr_offsets(arcs_of(edges(spark, GOLDEN))).orderBy("id").collect()
    assert [(x.idx, x.degree, x["first"], x["last"]) for x in got] == [(0, 2, 0, 2), (1, 4, 2, 6), (2, 3, 6, 9), (3, 3, 9, 12), (4, 2, 12, 14), (5, 2, 14, 16)]
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    total, sums = 0, {x.id: x.s for x in running_sum(df, ["id"], "n", "s").collect()}
    for i in range(1000):
        total += i % 7
        assert sums[i] == total
    assert {x.id: x.idx for x in dense_ids(spark.createDataFrame([(5,), (2,), (9,), (2,)], "id long")).collect()} == {2: 0, 5: 1, 9: 2}
