import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions.bits import high_bit, int_log2
from pairwright.operators import coloring, community, generators, partition, stats
from pairwright.operators.graph import arc_positions, arcs_of, asymmetric, csr_offsets, vertices_of
from pairwright.plans import registry
from tests.test_matching import GOLDEN, edges


@pytest.fixture()
def arcs(spark):
    return arcs_of(edges(spark, GOLDEN))


def comm(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, c long")


def test_stats(spark, arcs):
    got = {x.id: x for x in stats.vertex_stats(arcs, spark.range(8)).collect()}
    assert [got[i].degree for i in range(8)] == [2, 4, 3, 3, 2, 2, 0, 0]
    assert [round(got[i].weighted_degree, 9) for i in range(6)] == [5.2, 6.4, 12.3, 13.4, 4.3, 10.4]
    assert [got[i].max_weight for i in range(7)] == [5.1, 3.1, 5.1, 7.2, 3.2, 7.2, 0.0]
    x = stats.degree_summary(arcs).first()
    assert (x.vertices, x.arcs, x.max_degree, x.median_degree, x.mean_square, x.variance, x.stddev) == (6, 16, 4, 2.5, 7.666667, 0.555556, 0.745356)
    assert round(stats.total_mass(arcs).first().mass, 9) == 26.0
    low = spark.createDataFrame([(0, 1, -3.0), (1, 0, -3.0)], "src long, dst long, w double")
    assert {x.max_weight for x in stats.vertex_stats(low).collect()} == {0.0}


def test_modularity_and_moves(spark, arcs):
    assert round(community.modularity(arcs, comm(spark, range(6))).first()[0], 6) == -0.194342
    assert round(community.modularity(arcs, comm(spark, [0, 1, 0, 3, 1, 3])).first()[0], 6) == 0.150303
    moved = {x.id: x.c for x in community.move(arcs, comm(spark, range(6))).collect()}
    assert moved == {0: 2, 1: 2, 2: 0, 3: 5, 4: 5, 5: 3}
    assert round(community.modularity(arcs, comm(spark, [moved[i] for i in range(6)])).first()[0], 6) == -0.257729


def test_community_weights_and_coarsening(spark, arcs):
    k, a, b = community.strengths_of(arcs), comm(spark, [0, 0, 0, 1, 1, 1]), comm(spark, [0, 1, 0, 1, 5, 1])
    now = community.updated_weights(community.community_weights(k, a), k, a, b)
    direct = {x.c: round(x.w, 9) for x in community.community_weights(k, b).collect()}
    assert {x.c: round(x.w, 9) for x in now.collect() if abs(x.w) > 1e-9} == direct
    coarse = community.coarsen(arcs, a)
    assert round(coarse.agg(F.sum("w")).first()[0], 9) == 52.0 and coarse.count() == 4
    assert abs(community.modularity(coarse, comm(spark, [0, 1])).first()[0] - community.modularity(arcs, a).first()[0]) < 1e-9
    assert {x.id: x.c for x in community.renumbered(b).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2, 5: 1}


def test_louvain_finds_two_cliques(spark):
    rows = [(a, b, 1.0) for g in (0, 5) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 5, 0.1)]
    found = {x.id: x.c for x in community.louvain(arcs_of(edges(spark, rows)), phases=3, sweeps=4).collect()}
    assert {frozenset(i for i in found if found[i] == c) for c in set(found.values())} == {frozenset(range(5)), frozenset(range(5, 10))}


@pytest.mark.parametrize("finish", [0, 10**6])
def test_coloring(spark, arcs, finish):
    got = coloring.color(arcs, spark.range(8), finish_arcs=finish)
    x = coloring.conflicts(arcs, got).first()
    assert x.conflicts == 0 and x.colors <= 5 and got.count() == 8
    by_id = {x.id: x.color for x in coloring.color(arcs, vertices_of(arcs), F.col("id"), finish).collect()}
    assert by_id == {5: 0, 4: 1, 3: 1, 2: 0, 1: 2, 0: 1}


def test_coloring_is_the_same_either_way(spark):
    some = generators.scale_free(spark, 60, 2)
    got = [sorted(map(tuple, coloring.color(some, spark.range(62), finish_arcs=n).collect())) for n in (0, 40, 10**6)]
    assert got[0] == got[1] == got[2] and coloring.conflicts(some, spark.createDataFrame(got[0], "id long, color long")).first().conflicts == 0
    assert coloring.color(some.filter("false"), spark.range(0)).count() == 0


def greedy(pairs, ids, rank):
    """Through the vertices by descending rank, each with the smallest colour that no neighbour has."""
    near, out = {i: set() for i in ids}, {}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(ids, key=rank, reverse=True):
        taken = {out[n] for n in near[i] if n in out}
        out[i] = next(c for c in range(len(near[i]) + 1) if c not in taken)
    return out


def test_rounds_of_a_coloring_are_fewer_than_its_longest_path(spark, monkeypatch):
    stored, write = [], coloring.Scratch.write
    monkeypatch.setattr(coloring.Scratch, "write", lambda self, df, name="t": stored.append(f"{self.label}-{name}") or write(self, df, name))
    pairs = [(i, i + 1) for i in range(59)] + [(i, 100 + j) for i in range(12) for j in range(6)]
    ids = sorted({x for p in pairs for x in p})
    got = coloring.color(arcs_of(edges(spark, [(a, b, 1.0) for a, b in pairs])), spark.createDataFrame([(i,) for i in ids], "id long"), F.col("id"), finish_arcs=20)
    assert {x.id: x.color for x in got.collect()} == greedy(pairs, ids, lambda i: i)
    assert stored.count("coloring-open") <= 16


def test_vertices_with_more_arcs_than_one_task_takes(spark):
    pairs = [(0, i) for i in range(1, 50)] + [(i, i + 1) for i in range(1, 49)]
    for sign in (1, -1):  # the hub is the last, or the first
        got = coloring.color(arcs_of(edges(spark, [(a, b, 1.0) for a, b in pairs])), spark.range(52), sign * F.col("id"), finish_arcs=30)
        assert {x.id: x.color for x in got.collect()} == greedy(pairs, range(52), lambda i: sign * i)


def test_ranges(spark, arcs):
    offsets = csr_offsets(arcs)
    ranges = lambda df: [(x.lo, x.hi) for x in df.orderBy("part").collect()]
    assert ranges(partition.edge_balanced(offsets, 2)) == [(0, 3), (3, 6)]
    assert ranges(partition.vertex_balanced(spark, 10, 3)) == [(0, 3), (3, 6), (6, 10)]
    assert ranges(partition.greedy(offsets, 5)) == [(0, 2), (2, 4), (4, 6)]
    assert ranges(partition.greedy(offsets, 6, overflow=False)) == [(0, 2), (2, 4), (4, 6)]
    assert ranges(partition.greedy(offsets, 1, overflow=False)) == [(i, i + 1) for i in range(6)]
    assert partition.capacity(1000, 0, 5, 16) == 0 and partition.capacity(10**9, 10, 5, 16) == 5
    located = partition.locate(offsets.select("idx"), partition.edge_balanced(offsets, 2)).orderBy("idx").collect()
    assert [(x.part, x.offset) for x in located] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


def test_grid(spark, arcs):
    assert partition.grid(6) == (2, 3) and partition.grid(7) == (1, 7) and partition.grid(16) == (4, 4)
    got = partition.on_grid(arcs, partition.hashed("src", 6), partition.hashed("dst", 6), 6).collect()
    assert all(0 <= x.rank < 6 and 0 <= x.edge_part < 18 and 0 <= x.local_part < 3 for x in got)


def test_ranges_within_ranges(spark, arcs):
    offsets = csr_offsets(arcs)
    got = partition.edge_balanced_within(offsets, partition.edge_balanced(offsets, 2), 2).orderBy("part", "batch").collect()
    assert [tuple(x) for x in got] == [(0, 0, 0, 1), (0, 1, 1, 3), (1, 0, 3, 4), (1, 1, 4, 6)]  # arcs 0-9 and 9-16, cut near 4 (2 and 6 are as near) and 12
    star = csr_offsets(arcs_of(edges(spark, [(0, i, 1.0) for i in range(1, 30)])))
    ranges = partition.edge_balanced(star, 4)
    got = partition.edge_balanced_within(star, ranges, 3).orderBy("part", "batch").collect()
    assert [x.lo for x in got[1:]] == [x.hi for x in got[:-1]] and got[0].lo == 0 and got[-1].hi == 30 and len(got) == 12
    assert partition.edge_balanced_within(star.filter("false"), partition.edge_balanced(star.filter("false"), 2), 2).agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] == 0


def test_edge_ranks(spark):
    ranks = [x.r for x in spark.range(600).select(partition.edge_rank(F.col("id"), 6).alias("r")).collect()]
    assert set(ranks) == set(range(6)) and min(ranks.count(r) for r in range(6)) > 60


def test_positions_of_a_hub_in_many_partitions(spark):
    some = arcs_of(edges(spark, [(0, i, float(i)) for i in range(1, 500)] + [(i, i + 1, 1.0) for i in range(1, 60)]))
    got = sorted((x.src, x.dst, x.pos) for x in arc_positions(some).collect())
    want, at = [], {}
    for a, b in sorted((x.src, x.dst) for x in some.collect()):
        want.append((a, b, at.get(a, 0)))
        at[a] = at.get(a, 0) + 1
    assert got == want and arc_positions(some).columns == ["src", "dst", "w", "pos"]


def test_offsets_count_vertices_without_arcs_of_their_own(spark):
    one_way = spark.createDataFrame([(5, 9, 1.0), (5, 7, 1.0), (9, 3, 1.0)], "src long, dst long, w double")
    assert sorted(map(tuple, csr_offsets(one_way).collect())) == [(3, 0, 0, 0, 0), (5, 1, 2, 0, 2), (7, 2, 0, 2, 2), (9, 3, 1, 2, 3)]


def test_tables_go_with_their_context(spark, arcs):
    from pairwright.plans.storage import _LIVE, temporary

    before = list(_LIVE)
    with temporary(spark):
        assert csr_offsets(arcs).count() == 6 and len(_LIVE) > len(before)
        with pytest.raises(ZeroDivisionError), temporary(spark):
            csr_offsets(arcs)
            raise ZeroDivisionError
    assert _LIVE == before


def test_bits(spark):
    values = [0, 1, 2, 3, 4, 2**31, 2**53 - 1, 2**53, 2**62, 2**63 - 1]
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", int_log2(F.col("x")).alias("l"), high_bit(F.col("x")).alias("b")).collect()
    assert [(x.l, x.b) for x in got] == [(v.bit_length() - 1, 1 << (v.bit_length() - 1)) if v else (None, None) for v in values]


def test_generator(spark):
    a, b = generators.scale_free(spark, 500, 3, parts=2), generators.scale_free(spark, 500, 3, parts=7)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect())) and len(rows) == 2 * (3 + 496 * 3)
    assert asymmetric(a).count() == 0 and a.filter("src = dst").count() == 0 and min(r[2] for r in rows) >= 0
    degree = np.bincount([r[0] for r in rows])
    assert degree.min() >= 1 and degree[4:].min() >= 3 and degree.max() > 5 * np.median(degree)
    flat = generators.random_weights(a)
    assert asymmetric(flat).count() == 0 and 0 <= flat.agg(F.min("w")).first()[0] and flat.agg(F.max("w")).first()[0] < 1
    with pytest.raises(ValueError):
        generators.scale_free(spark, 3, 3)


def test_stream_of_edges(spark, tmp_path):
    from pairwright.streaming.degrees import running_degrees

    edges(spark, GOLDEN).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u long, v long, w double").parquet(f"{tmp_path}/in")
    q = running_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert {x.id: x.degree for x in spark.table("degrees").collect()} == {0: 2, 1: 4, 2: 3, 3: 3, 4: 2, 5: 2}


@pytest.mark.parametrize("files_at_once", [1, 3])
def test_stream_of_files_in_batches(spark, tmp_path, files_at_once):
    from pairwright.streaming.degrees import degrees_of_files

    for i, row in enumerate(GOLDEN):
        edges(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = degrees_of_files(spark, f"{tmp_path}/in", files_at_once)
    assert {x.id: (x.degree, round(x.weighted_degree, 9)) for x in got.collect()} == {0: (2, 5.2), 1: (4, 6.4), 2: (3, 12.3), 3: (3, 13.4), 4: (2, 4.3), 5: (2, 10.4)}


def test_coloring_check_derives_its_graph_once(spark, monkeypatch):
    stored, write = [], registry.Scratch.write
    monkeypatch.setattr(registry.Scratch, "write", lambda self, df, name="t": stored.append(f"{self.label}-{name}") or write(self, df, name))
    got = registry.QUERIES["coloring_check"](spark, "/root/testdata/sf0.001")
    assert [tuple(x) for x in got.collect()] == [(0, True)] and stored.count("graph-edges") == 1
