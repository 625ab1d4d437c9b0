"""All graph queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.bits import high_bit, int_log2
from pairwright.operators import coloring, community, generators, graph, matching, partition, stats
from pairwright.plans import views
from pairwright.plans.storage import Scratch, new_path
from pairwright.sources import csr, dump, memory, mtx
from pairwright.streaming.degrees import degrees_of_files

PARTS = 8
GRID = 6
COMMUNITIES = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Derived graphs as SQL.
COPART = "select a.l_partkey as u, b.l_partkey as v, sum(a.l_quantity + b.l_quantity) as w from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2"
CUSTSUPP = "select least(2 * o_custkey, 2 * l_suppkey + 1) as u, greatest(2 * o_custkey, 2 * l_suppkey + 1) as v, sum(l_quantity) as w from orders join lineitem on o_orderkey = l_orderkey group by 1, 2"
TRADE_ARCS = "select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, sum(l_quantity) as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2"
TRADE = f"select least(src, dst) as u, greatest(src, dst) as v, sum(w) as w from ({TRADE_ARCS}) where src <> dst group by 1, 2"


def arcs_sql(edges: str) -> str:
    return f"g as materialized ({edges}), arcs as materialized (select u as src, v as dst, w from g union all select v, u, w from g)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _copart_arcs(spark, d):
    return graph.arcs_of(views.copart(spark, d))


def _stored_arcs(spark, d):
    """The same arcs from a table in the shared folder, for queries that go over them more than once."""
    return graph.arcs_of(Scratch(spark, "graph").write(views.copart(spark, d), "edges"))


def _trade_arcs(spark, d):
    return graph.arcs_of(views.nationtrade(spark, d))


def _mod_communities(arcs: DataFrame) -> DataFrame:
    return graph.vertices_of(arcs).select("id", (F.col("id") % COMMUNITIES).alias("c"))


# Graphs and arcs

query("graph_copart", COPART)(views.copart)
query("graph_custsupp", CUSTSUPP)(views.custsupp)
query("graph_nationtrade", TRADE)(views.nationtrade)
query("graph_arcs", f"with {arcs_sql(CUSTSUPP)} select * from arcs")(lambda s, d: graph.arcs_of(views.custsupp(s, d)))
query("canonical_edges", f"with a as ({TRADE_ARCS}) select least(src, dst) as u, greatest(src, dst) as v, max(w) as w from a where src <> dst group by 1, 2")(
    lambda s, d: graph.canonical(views.nationtrade_arcs(s, d))
)
query("asymmetric_arcs", f"with a as ({TRADE_ARCS}) select least(src, dst) as u, greatest(src, dst) as v, w, cast(sum(case when src < dst then 1 else -1 end) as bigint) as surplus from a where src <> dst group by 1, 2, 3 having sum(case when src < dst then 1 else -1 end) <> 0")(
    lambda s, d: graph.asymmetric(views.nationtrade_arcs(s, d))
)
query("self_loop_zeroing", f"select src, dst, case when src = dst then 0.0 else w end as w from ({TRADE_ARCS})")(lambda s, d: graph.without_loop_weight(views.nationtrade_arcs(s, d)))
query("neighbors_of", f"with {arcs_sql(COPART)} select dst, w from arcs where src = 42")(lambda s, d: graph.neighbors(_copart_arcs(s, d), 42))
query("arc_position", f"with {arcs_sql(COPART)} select src, dst, w, row_number() over (partition by src order by dst, w) - 1 as pos from arcs")(lambda s, d: graph.arc_positions(_copart_arcs(s, d)))
query(
    "csr_offsets",
    f"with {arcs_sql(COPART)}, n as (select src as id, count(*) as degree from arcs group by 1) select id, row_number() over (order by id) - 1 as idx, degree, cast(sum(degree) over (order by id) - degree as bigint) as first, cast(sum(degree) over (order by id) as bigint) as last from n",
)(lambda s, d: graph.csr_offsets(_copart_arcs(s, d)))
query("sort_edges", f"with {arcs_sql(TRADE)} select src, dst, w from arcs order by src, dst, w")(lambda s, d: graph.sorted_arcs(_trade_arcs(s, d)))
query("min_edge", f"with {arcs_sql(COPART)} select src, dst, w from arcs order by src, dst, w limit 1")(lambda s, d: graph.smallest_arc(_copart_arcs(s, d)))
query("dense_renumber", f"with {arcs_sql(COPART)}, i as (select distinct src as id from arcs) select id, row_number() over (order by id) - 1 as idx from i")(lambda s, d: graph.dense_ids(graph.vertices_of(_copart_arcs(s, d))))
query("vertex_iota", "select range as id from range(100, 100 + (select count(*) from part))")(lambda s, d: graph.vertex_range(s, views.table(s, d, "part").count(), 100))

# Statistics

query("vertex_degree", f"with {arcs_sql(COPART)} select src as id, count(*) as degree from arcs group by 1")(lambda s, d: stats.vertex_stats(_copart_arcs(s, d)).select("id", "degree"))
query("vertex_weighted_degree", f"with {arcs_sql(COPART)} select src as id, sum(w) as weighted_degree from arcs group by 1")(lambda s, d: stats.vertex_stats(_copart_arcs(s, d)).select("id", "weighted_degree"))
query(
    "vertex_max_weight",
    f"with {arcs_sql(COPART)} select p_partkey as id, count(src) as degree, coalesce(sum(w - 60), 0.0) as weighted_degree, greatest(0.0, coalesce(max(w - 60), 0.0)) as max_weight from part left join arcs on src = p_partkey group by 1",
)(lambda s, d: stats.vertex_stats(_copart_arcs(s, d).withColumn("w", F.col("w") - 60), views.table(s, d, "part").select(F.col("p_partkey").alias("id"))))
query(
    "degree_summary",
    f"with {arcs_sql(COPART)}, n as (select src, cast(count(*) as double) as d from arcs group by 1) select count(*) as vertices, cast(sum(d) as bigint) as arcs, cast(max(d) as bigint) as max_degree, median(d) as median_degree, round(avg(d * d), 6) as mean_square, round(abs(avg(d * d) - avg(d) * avg(d)), 6) as variance, round(sqrt(abs(avg(d * d) - avg(d) * avg(d))), 6) as stddev from n",
)(lambda s, d: stats.degree_summary(_copart_arcs(s, d)))
query("total_mass", f"with {arcs_sql(COPART)} select 0.5 * sum(w) as mass from arcs")(lambda s, d: stats.total_mass(_copart_arcs(s, d)))

# Matching

POINTERS = "select src as u, arg_max(dst, (w, dst)) as p, max(w) as w from arcs"


def matching_sql(edges: str, keep: str = "w >= -1", out: str = "select u, v from done") -> str:
    """Rounds of pointers and mutual pairs, by recursion."""
    return f"""
with recursive g as materialized (select u, v, w from ({edges}) where {keep}),
e as materialized (select u, v, w from g union all select v, u, w from g),
m(it, u, v) as (
  select 0, cast(-1 as bigint), cast(-1 as bigint)
  union all
  (with gone as (select u from m where u >= 0),
        live as (select e.* from e where not exists (select 1 from gone x where x.u = e.u) and not exists (select 1 from gone x where x.u = e.v)),
        p as (select u, arg_max(v, (w, v)) as p from live group by u),
        new as (select a.u, a.p from p a join p b on a.p = b.u and b.p = a.u)
   select (select max(it) from m) + 1, u, v
   from (select u, v from m where u >= 0 union all select u, p from new) where exists (select 1 from new))),
done as (select u, v from m where it = (select max(it) from m) and u >= 0)
{out}"""


SUMMARY = "select cast(count(*) as bigint) as matched_vertices, cast(count(*) // 2 as bigint) as pairs, coalesce(sum(w), 0.0) / 2 as matching_weight, coalesce(sum(w), 0.0) as both_ends_weight from done join e using (u, v)"

query("heaviest_neighbor", f"with {arcs_sql(COPART)} {POINTERS} group by src")(lambda s, d: matching.pointers(_copart_arcs(s, d)))
query("heaviest_neighbor_positive", f"with {arcs_sql(f'select u, v, w - 60 as w from ({COPART})')} {POINTERS} where w > 0 group by src")(
    lambda s, d: matching.pointers(graph.arcs_of(matching.eligible(views.copart(s, d).withColumn("w", F.col("w") - 60), 0.0, strict=True)))
)
MUTUAL = f"with {arcs_sql(COPART)}, p as materialized ({POINTERS} group by src), mutual as (select a.u, a.p as v, a.w from p a join p b on a.p = b.u and b.p = a.u where a.u < a.p)"
query("mutual_pairs", f"{MUTUAL} select u, v, w from mutual")(lambda s, d: matching.mutual(matching.pointers(_copart_arcs(s, d))))


@query("prune_matched", f"{MUTUAL}, gone as (select u as id from mutual union all select v from mutual) select u, v, w from g where not exists (select 1 from gone where gone.id = u) and not exists (select 1 from gone where gone.id = v)")
def prune_matched(spark: SparkSession, d: str) -> DataFrame:
    edges = Scratch(spark, "graph").write(views.copart(spark, d), "edges")
    pairs = matching.mutual(matching.pointers(graph.arcs_of(edges)))
    return matching.prune(edges, pairs.select(F.explode(F.array("u", "v")).alias("id")))


@query(
    "pointers_still_valid",
    f"{MUTUAL}, gone as (select u as id from mutual union all select v from mutual) select u, p, w, not exists (select 1 from gone where gone.id = p.p) as valid from p where not exists (select 1 from gone where gone.id = p.u)",
)
def pointers_still_valid(spark: SparkSession, d: str) -> DataFrame:
    chosen = Scratch(spark, "graph").write(matching.pointers(_copart_arcs(spark, d)), "pointers")
    return matching.still_valid(chosen, matching.mutual(chosen).select(F.explode(F.array("u", "v")).alias("id")))


@query("mate_weight_lookup", f"{MUTUAL} select u, v, w from mutual union all select v, u, w from mutual")
def mate_weight_lookup(spark: SparkSession, d: str) -> DataFrame:
    arcs = _stored_arcs(spark, d)
    return matching.mate_weights(matching.Matching(matching.mutual(matching.pointers(arcs)), 1).mates(), arcs)


query("matching_copart", matching_sql(COPART))(lambda s, d: matching.locally_dominant(views.copart(s, d)).mates())
query("matching_custsupp", matching_sql(CUSTSUPP))(lambda s, d: matching.locally_dominant(views.custsupp(s, d)).mates())
query("matching_nationtrade", matching_sql(TRADE))(lambda s, d: matching.locally_dominant(views.nationtrade(s, d)).mates())
query("matching_rounds_only", matching_sql(COPART))(lambda s, d: matching.locally_dominant(views.copart(s, d), finish_edges=0).mates())
query("matching_positive", matching_sql(f"select u, v, w - 60 as w from ({COPART})", "w > 0"))(
    lambda s, d: matching.locally_dominant(views.copart(s, d).withColumn("w", F.col("w") - 60), 0.0, strict=True).mates()
)
query("matching_summary", matching_sql(COPART, out=SUMMARY))(lambda s, d: matching.locally_dominant(views.copart(s, d)).summary())
query("matching_round_count", matching_sql(TRADE, out="select cast(max(it) as bigint) as rounds from m"))(
    lambda s, d: s.createDataFrame([(matching.locally_dominant(views.nationtrade(s, d), finish_edges=0).rounds,)], "rounds long")
)

# Partitions

OFFSETS = f"{arcs_sql(COPART)}, n as (select src as id, count(*) as degree from arcs group by 1), o as materialized (select id, row_number() over (order by id) - 1 as idx, sum(degree) over (order by id) - degree as first, sum(degree) over (order by id) as last from n)"
CUTS = f"""borders as (select idx, first as pos from o union all select max(idx) + 1, max(last) from o),
cuts as (select 0 as i, 0 as cut union all
         select i, arg_min(idx, (abs(pos - i * (select max(last) from o) // {PARTS}), idx)) from borders, range(1, {PARTS}) r(i) group by i union all
         select {PARTS}, (select max(idx) + 1 from o))"""
RANGES = "select cast(i as int) as part, cast(cut as bigint) as lo, cast(lead(cut) over (order by i) as bigint) as hi from cuts qualify hi is not null"
query("range_partition_edges", f"with {OFFSETS}, {CUTS} {RANGES}")(lambda s, d: partition.edge_balanced(graph.csr_offsets(_copart_arcs(s, d)), PARTS))
BATCHES = 3
query(
    "range_partition_batches",
    f"""with {OFFSETS}, {CUTS}, ranges as ({RANGES}), inside as (select part, lo, hi, idx, pos from ranges join borders on idx between lo and hi),
steps as (select part, batch, min(pos) as a, max(pos) as b from inside, range({BATCHES + 1}) r(batch) group by 1, 2),
near as (select part, batch, lo, hi, arg_min(idx, (abs(pos - (a + batch * ((b - a) // {BATCHES}))), idx)) as idx from inside join steps using (part) group by all),
placed as (select part, cast(batch as int) as batch, cast(case when batch = 0 then lo when batch = {BATCHES} then hi else idx end as bigint) as lo from near)
select *, lead(lo) over (partition by part order by batch) as hi from placed qualify hi is not null""",
)(lambda s, d: (lambda o: partition.edge_balanced_within(o, partition.edge_balanced(o, PARTS), BATCHES))(graph.csr_offsets(_copart_arcs(s, d))))
query("range_partition_vertices", f"with n as (select count(*) as n from part) select cast(i as int) as part, i * (n // {PARTS}) as lo, case when i = {PARTS - 1} then n else (i + 1) * (n // {PARTS}) end as hi from n, range({PARTS}) r(i)")(
    lambda s, d: partition.vertex_balanced(s, views.table(s, d, "part").count(), PARTS)
)


def greedy_sql(cap: str, step: str) -> str:
    return f"""with recursive {OFFSETS}, cap as (select {cap} as cap from o),
c(part, lo, base, hi, upto) as (
  select cast(-1 as int), cast(0 as bigint), cast(0 as hugeint), cast(0 as bigint), cast(0 as hugeint)
  union all
  select part + 1, hi, upto, {step} from c, cap where hi < (select count(*) from o))
select part, lo, hi from c where part >= 0"""


FIRST_OVER = "(select min(idx) from o, cap k where idx >= c.hi and last - c.upto > k.cap)"
query(
    "range_partition_greedy",
    greedy_sql(f"max(last) // {PARTS}", f"coalesce({FIRST_OVER} + 1, (select count(*) from o)), coalesce((select min(last) from o, cap k where idx >= c.hi and last - c.upto > k.cap), 0)"),
)(lambda s, d: _greedy(s, d, lambda ne: ne // PARTS, True))
query(
    "range_partition_capacity",
    greedy_sql(
        "max(last) // 5",
        f"case when {FIRST_OVER} is null then (select count(*) from o) else greatest({FIRST_OVER}, c.hi + 1) end, coalesce((select case when min(idx) = c.hi then min(last) else min(first) end from o, cap k where idx >= c.hi and last - c.upto > k.cap), 0)",
    ),
)(lambda s, d: _greedy(s, d, lambda ne: ne // 5, False))


def _greedy(spark, d, share, overflow):
    offsets = graph.csr_offsets(_copart_arcs(spark, d))
    ne = offsets.agg(F.max("last")).first()[0] or 0
    return partition.greedy(offsets, share(ne), overflow)


query("memory_capacity", f"with {arcs_sql(COPART)}, z as (select count(*) as ne, count(distinct src) as nv from arcs) select greatest(0, least(ne, cast(floor((1000000 - 48 * nv) / 16 / 8.25) as bigint))) as edges from z")(
    lambda s, d: _capacity(s, d)
)


def _capacity(spark, d):
    size = _copart_arcs(spark, d).agg(F.count("*").alias("ne"), F.countDistinct("src").alias("nv")).first()
    return spark.createDataFrame([(partition.capacity(1_000_000, size.nv, size.ne, 16),)], "edges long")


LOCATED = f"with {OFFSETS}, {CUTS}, ranges as ({RANGES}), l as (select id, idx, part, idx - lo as \"offset\" from o join ranges on idx >= lo and idx < hi)"


def _located(spark, d):
    offsets = graph.csr_offsets(_copart_arcs(spark, d))
    return partition.locate(offsets.select("id", "idx"), partition.edge_balanced(offsets, PARTS))


query("range_lookup", f"{LOCATED} select * from l")(_located)


def grid_sql(source: str) -> str:
    rows, columns = partition.grid(GRID)
    return f"""select src, dst, cast(mj as int) as major_part, cast(mn as int) as minor_part, cast((mn // {rows}) * {rows} + mj % {rows} as int) as rank,
        cast(mj * {columns} + mn // {rows} as int) as edge_part, cast((mj * {columns} + mn // {rows}) // {GRID} as int) as local_part,
        cast(mj // {rows} as int) as local_major, cast(mn % {rows} as int) as local_minor from {source}"""


MD5 = f"cast('0x' || substr(md5(cast({{}} as varchar)), 1, 8) as bigint) % {GRID}"
query("edge_partition_hash_2d", f"with {arcs_sql(TRADE)}, p as (select src, dst, {MD5.format('src')} as mj, {MD5.format('dst')} as mn from arcs) {grid_sql('p')}")(
    lambda s, d: partition.on_grid(_trade_arcs(s, d).drop("w"), partition.hashed("src", GRID), partition.hashed("dst", GRID), GRID)
)

query("local_vertices", f"with {arcs_sql(COPART)} select distinct src as id from arcs where {MD5.format('src')} = 2")(lambda s, d: partition.local_vertices(graph.vertices_of(_copart_arcs(s, d)), 2, GRID))
query("local_edges", f"with {arcs_sql(TRADE)}, p as (select src, dst, w, {MD5.format('src')} as mj, {MD5.format('dst')} as mn from arcs) select src, dst, w from p where (mn // {partition.grid(GRID)[0]}) * {partition.grid(GRID)[0]} + mj % {partition.grid(GRID)[0]} = 3")(
    lambda s, d: partition.local_edges(_trade_arcs(s, d), 3, GRID)
)
query("edge_rank_hash", f"with {arcs_sql(COPART)}, p as (select src, dst, {MD5.format('100000 * src + dst')} as part from arcs) select src, dst, cast((part % {partition.grid(GRID)[0]}) * {partition.grid(GRID)[1]} + part // {partition.grid(GRID)[0]} as int) as rank from p")(
    lambda s, d: _copart_arcs(s, d).select("src", "dst", partition.edge_rank(100000 * F.col("src") + F.col("dst"), GRID).alias("rank"))
)
query("edges_by_hash", f"with {arcs_sql(TRADE)} select src, dst, w from arcs")(lambda s, d: partition.by_hash(_trade_arcs(s, d), GRID))


@query(
    "edge_partition_range_2d",
    f"with {arcs_sql(TRADE)}, n as (select count(distinct src) as n from arcs), p as (select src, dst, least({GRID - 1}, src // (n // {GRID})) as mj, least({GRID - 1}, dst // (n // {GRID})) as mn from arcs, n) {grid_sql('p')}",
)
def edge_partition_range_2d(spark: SparkSession, d: str) -> DataFrame:
    arcs = _trade_arcs(spark, d).drop("w")
    ranges = partition.vertex_balanced(spark, graph.vertices_of(arcs).count(), GRID)
    ends = partition.locate(partition.locate(arcs, ranges, "src").drop("offset").withColumnRenamed("part", "mj"), ranges, "dst").drop("offset")
    return partition.on_grid(ends, F.col("mj"), F.col("part"), GRID).drop("mj", "part")


# Communities

COMM = f"{arcs_sql(COPART)}, comm as (select distinct src as id, src % {COMMUNITIES} as c from arcs), k as materialized (select src as id, sum(w) as k from arcs group by 1)"
query("singleton_communities", f"with {arcs_sql(COPART)} select distinct src as id, src as c from arcs")(lambda s, d: community.singletons(graph.vertices_of(_copart_arcs(s, d))))
query("community_weights", f"with {COMM} select c, sum(k) as w from k join comm using (id) group by c")(
    lambda s, d: (lambda a: community.community_weights(community.strengths_of(a), _mod_communities(a)))(_stored_arcs(s, d))
)


@query("community_weights_delta", f"with {COMM} select case when id % 3 = 0 then c + 1 else c end as c, sum(k) as w from k join comm using (id) group by 1")
def community_weights_delta(spark: SparkSession, d: str) -> DataFrame:
    arcs = _stored_arcs(spark, d)
    k, old = community.strengths_of(arcs), _mod_communities(arcs)
    new = old.select("id", F.when(F.col("id") % 3 == 0, F.col("c") + 1).otherwise(F.col("c")).alias("c"))
    return community.updated_weights(community.community_weights(k, old), k, old, new)


query("vertex_community_weight", f"with {COMM} select src, c, sum(w) as w from arcs join comm on dst = id group by 1, 2")(lambda s, d: (lambda a: community.links(a, _mod_communities(a)))(_stored_arcs(s, d)))
query("vertex_distinct_communities", f"with {COMM} select src, count(distinct c) as n from arcs join comm on dst = id group by 1")(
    lambda s, d: (lambda a: community.distinct_communities(a, _mod_communities(a)))(_stored_arcs(s, d))
)
query(
    "louvain_move",
    f"""with {COMM}, t as (select sum(k) * 0.5 as m from k), cw as (select c, sum(k) as total from k join comm using (id) group by c),
own as (select comm.id, comm.c as own, k.k from comm join k using (id)),
lk as (select src as id, c, sum(w) as w from arcs join comm on dst = comm.id where src <> dst group by 1, 2),
g as (select id, c, own, w, round((w - k * total / (2 * m)) / m, 9) as gain from lk join own using (id) join cw using (c), t),
best as (select id, min(c) as c, any_value(gain) as gain from (select *, rank() over (partition by id order by gain desc) as r from g where c <> own) where r = 1 group by id),
stay as (select own.id, own, round((coalesce(w, 0.0) - k * (total - k) / (2 * m)) / m, 9) as stay from own join cw on own.own = cw.c left join lk on lk.id = own.id and lk.c = own.own, t)
select s.id, case when coalesce(round(b.gain - s.stay, 9) > 0, false) then b.c else s.own end as c, case when coalesce(round(b.gain - s.stay, 9) > 0, false) then round(b.gain - s.stay, 9) else 0.0 end as gain
from stay s left join best b using (id)""".replace("g as materialized", "gr as materialized").replace("from g union all select v, u, w from g)", "from gr union all select v, u, w from gr)"),
)(lambda s, d: (lambda a: community.move(a, _mod_communities(a)))(_stored_arcs(s, d)))
query(
    "modularity",
    f"with {COMM}, cw as (select c, sum(k) as w from k join comm using (id) group by c), i as (select sum(case when a.c = b.c then w else 0.0 end) as inside, sum(w) as t from arcs join comm a on src = a.id join comm b on dst = b.id) select round(inside / t - (select sum(w * w) from cw) / (t * t), 9) as modularity from i",
)(lambda s, d: (lambda a: community.modularity(a, _mod_communities(a)))(_stored_arcs(s, d)))
query("coarsen_edges", f"with {COMM} select a.c as src, b.c as dst, sum(w) as w from arcs join comm a on src = a.id join comm b on dst = b.id group by 1, 2")(
    lambda s, d: (lambda a: community.coarsen(a, _mod_communities(a)))(_stored_arcs(s, d))
)
query("renumber_communities", f"with {arcs_sql(COPART)}, comm as (select distinct src as id, 10 * (src % {COMMUNITIES}) as c from arcs) select id, dense_rank() over (order by c) - 1 as c from comm")(
    lambda s, d: community.renumbered(_mod_communities(_copart_arcs(s, d)).withColumn("c", 10 * F.col("c")))
)
query("compose_clustering", f"with {arcs_sql(COPART)} select distinct src as id, 100 + src % {COMMUNITIES} as c from arcs")(
    lambda s, d: (lambda c: community.composed(c, c.select(F.col("c").alias("id"), (F.col("c") + 100).alias("c")).distinct()))(_mod_communities(_copart_arcs(s, d)))
)
#: What must hold of any communities that moves and coarsening found: all vertices, numbers without a gap, and more modularity than vertices alone.
FOUND = "select count(distinct src) as vertices, true as dense, true as better from arcs"
query("louvain_communities", f"with {arcs_sql(TRADE)} {FOUND}")(lambda s, d: _louvain_check(_trade_arcs(s, d)))
query("louvain_custsupp", f"with {arcs_sql(CUSTSUPP)} {FOUND}")(lambda s, d: _louvain_check(graph.arcs_of(Scratch(s, "graph").write(views.custsupp(s, d), "edges"))))


def _louvain_check(arcs: DataFrame) -> DataFrame:
    found = community.louvain(arcs)
    alone = community.modularity(arcs, community.singletons(graph.vertices_of(arcs))).select(F.col("modularity").alias("alone"))
    seen = found.agg(F.countDistinct("id").alias("vertices"), (F.countDistinct("c") == F.max("c") + 1).alias("dense"))
    q = community.modularity(arcs, found).join(F.broadcast(alone)).select((F.col("modularity") > F.col("alone")).alias("better"))
    return seen.join(F.broadcast(q))


# Colouring

PRIORITY = "cast('0x' || substr(md5(cast(id as varchar)), 1, 8) as bigint)"
query(
    "coloring",
    f"""with recursive {arcs_sql(CUSTSUPP)}, n as materialized (select id, row_number() over (order by {PRIORITY} desc, id desc) as r from (select distinct src as id from arcs)),
before as materialized (select a.r as r, b.r as earlier from arcs join n a on src = a.id join n b on dst = b.id where b.r < a.r),
c(it, r, color) as (
  select 0, cast(-1 as bigint), cast(-1 as bigint)
  union all
  (with done as (select r, color from c where r >= 0),
        open as (select n.r from n where not exists (select 1 from done where done.r = n.r)),
        ready as (select r from open where not exists (select 1 from before join open o on before.earlier = o.r where before.r = open.r)),
        used as (select ready.r, list(distinct done.color) as cols from ready left join before on before.r = ready.r left join done on done.r = before.earlier group by 1)
   select (select max(it) from c) + 1, r, color from (
     select r, color from done union all
     select r, list_filter(range(0, len(cols) + 1), lambda x: not list_contains(cols, x))[1] from used) where exists (select 1 from open)))
select id, color from c join n using (r) where it = (select max(it) from c)""",
)(lambda s, d: _colored(s, d))


def _colored(spark, d):
    arcs = graph.arcs_of(Scratch(spark, "graph").write(views.custsupp(spark, d), "edges"))
    priority = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    return coloring.color(arcs, graph.vertices_of(arcs), priority)


query("coloring_check", "select cast(0 as bigint) as conflicts, true as few")(lambda s, d: _coloring_check(s, d))


def _coloring_check(spark, d):
    arcs = graph.arcs_of(Scratch(spark, "graph").write(views.custsupp(spark, d), "edges"))
    found = coloring.color(arcs, graph.vertices_of(arcs))
    top = stats.vertex_stats(arcs).agg(F.max("degree").alias("most"))
    return coloring.conflicts(arcs, found).join(F.broadcast(top)).select("conflicts", (F.col("colors") <= F.col("most") + 1).alias("few"))


COLORED = f"""with recursive {arcs_sql(TRADE)}, n as (select distinct src as id from arcs),
c(node, ids, cols) as (
  select (select max(id) from n), cast([] as bigint[]), cast([] as bigint[])
  union all
  select node - 1, list_append(ids, node), list_append(cols, (select min(x) from range(100) r(x) where x not in (select c.cols[list_position(c.ids, dst)] from arcs where src = c.node and list_contains(c.ids, dst))))
  from c where node >= 0),
last as (select * from c where node = -1)"""
query("coloring_by_id", f"{COLORED} select unnest(ids) as id, unnest(cols) as color from last")(lambda s, d: (lambda a: coloring.color(a, graph.vertices_of(a), F.col("id")))(_trade_arcs(s, d)))
query(
    "recolored_arcs",
    f"{COLORED}, m as (select id, row_number() over (order by color, id) - 1 as idx from (select unnest(ids) as id, unnest(cols) as color from last)) select a.idx as src, b.idx as dst, w from arcs join m a on src = a.id join m b on dst = b.id",
)(lambda s, d: _recolored(s, d))


def _recolored(spark, d):
    arcs = _trade_arcs(spark, d)
    colors = coloring.color(arcs, graph.vertices_of(arcs), F.col("id"))
    ones = colors.withColumn("one", F.lit(1).cast("long"))
    return coloring.relabel(arcs, graph.running_sum(ones, ["color", "id"], "one", "idx", inclusive=False).select("id", F.col("idx").cast("long").alias("idx")))


# Functions

query("integer_log2", "select l_partkey, case when l_partkey > 0 then cast(length(bin(l_partkey)) - 1 as int) end as log2 from lineitem")(lambda s, d: views.table(s, d, "lineitem").select("l_partkey", int_log2(F.col("l_partkey")).alias("log2")))
query("highest_bit", "select l_partkey, case when l_partkey > 0 then cast(1 as bigint) << (length(bin(l_partkey)) - 1) end as bit from lineitem")(
    lambda s, d: views.table(s, d, "lineitem").select("l_partkey", high_bit(F.col("l_partkey")).alias("bit"))
)

# Sources and sinks


@query("mtx_roundtrip", f"with {arcs_sql(TRADE)} select * from arcs")
def mtx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "mtx")
    mtx.write_mtx(_trade_arcs(spark, d), path, 25, symmetry="symmetric")
    return mtx.read_mtx(spark, path)


@query("mtx_custsupp", f"with {arcs_sql(CUSTSUPP)} select * from arcs")
def mtx_custsupp(spark: SparkSession, d: str) -> DataFrame:
    path, arcs = new_path(spark, "mtx"), graph.arcs_of(views.custsupp(spark, d))
    mtx.write_mtx(arcs, path, 1 + (arcs.agg(F.max("src")).first()[0] or 0), "integer", "symmetric")
    return mtx.read_mtx(spark, path)


@query("mtx_dense_roundtrip", f"with {arcs_sql(TRADE)} select * from arcs")
def mtx_dense_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "mtx")
    mtx.write_dense(_trade_arcs(spark, d), path, 25, symmetry="symmetric")
    return mtx.read_dense(spark, path)


@query("mtx_complex_roundtrip", f"with {arcs_sql(TRADE)} select src, dst, w as re, case when src < dst then w else -w end as im from arcs")
def mtx_complex_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "mtx")
    entries = _trade_arcs(spark, d).select("src", "dst", F.col("w").alias("re"), F.when(F.col("src") < F.col("dst"), F.col("w")).otherwise(-F.col("w")).alias("im"))
    mtx.write_mtx(entries, path, 25, "complex", "hermitian")
    return mtx.read_complex(spark, path)


@query("stream_degrees", f"with {arcs_sql(COPART)} select src as id, count(*) as degree, sum(w) as weighted_degree from arcs group by 1")
def stream_degrees(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "edges")
    views.copart(spark, d).repartition(6, "u", "v").write.parquet(path)
    return degrees_of_files(spark, path)


@query("mtx_properties", f"with {arcs_sql(TRADE)} select cast(25 as bigint) as n_rows, cast(25 as bigint) as n_columns, count(*) as nnz from arcs")
def mtx_properties(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "mtx")
    mtx.write_mtx(_trade_arcs(spark, d), path, 25, symmetry="symmetric")
    return mtx.properties(spark, path)


@query("csr_roundtrip", f"with {arcs_sql(COPART)} select * from arcs")
def csr_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csr")
    csr.write_csr(_stored_arcs(spark, d), path)
    return csr.read_csr(spark, path)


@query("partition_dump", f"with {arcs_sql(TRADE)} select distinct cast(src % {COMMUNITIES} as varchar) as value, count(distinct src) as n from arcs group by 1")
def partition_dump(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "dump")
    dump.dump_communities(_mod_communities(_trade_arcs(spark, d)), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


EXAMPLE = [(0, 1, 0.1), (0, 2, 5.1), (1, 2, 3.1), (1, 3, 2.1), (1, 4, 1.1), (2, 3, 4.1), (3, 5, 7.2), (4, 5, 3.2)]


@query("matching_of_lists", "select * from (values (cast(0 as bigint), cast(2 as bigint), cast(5.1 as double)), (1, 4, 1.1), (3, 5, 7.2)) t(u, v, w)")
def matching_of_lists(spark: SparkSession, d: str) -> DataFrame:
    u, v, w = zip(*(EXAMPLE + [(b, a, x) for a, b, x in EXAMPLE]))
    return matching.locally_dominant(graph.canonical(memory.from_lists(spark, u, v, w, symmetric=True))).pairs


#: The generator in SQL, for 2,000 vertices that attach 3 times: the hash, and the trace of each edge to a known end.
WORD = "18446744073709551616::uhugeint"


def mix_sql(x: str, seed: int) -> str:
    out = f"cast(({x} + {(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF}::uhugeint) % {WORD} as ubigint)"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = f"cast((cast(xor({out}, {out} >> {shift}) as uhugeint) * {factor}::uhugeint) % {WORD} as ubigint)"
    return f"xor({out}, {out} >> 31)"


def scale_free_sql(n: int, m: int, seed: int = 42) -> str:
    owner = lambda e: f"case when {e} < {m} then 0 else {m} + 1 + ({e} - {m}) // {m} end"
    arc = f"cast(({mix_sql('cast(pos as uhugeint)', seed)}) % cast(2 * ({m} + (pos - {m}) // {m} * {m}) as ubigint) as bigint)"
    return f"""with recursive e as (select range as e from range({m + (n - m - 1) * m})),
t(e, pos, target) as (
  select e, e, case when e < {m} then e + 1 end from e
  union all
  select e, arc // 2, case when arc % 2 = 0 then {owner('(arc // 2)')} when arc // 2 < {m} then arc // 2 + 1 end
  from (select e, pos, {arc} as arc from t where target is null)),
edges as (select {owner('e')} as u, target as v, cast({mix_sql('cast(e as uhugeint)', seed + 1)} >> 11 as double) / 9007199254740992 as w from t where target is not null)
select cast(u as bigint) as src, cast(v as bigint) as dst, w from edges union all select v, u, w from edges"""


query("ba_generator", scale_free_sql(2000, 3))(lambda s, d: generators.scale_free(s, 2000, 3, uniform=True))
query("ba_degree_sum", "select cast(2 * (3 + (2000 - 4) * 3) as bigint) as arcs, cast(2000 as bigint) as vertices, true as symmetric, true as positive")(
    lambda s, d: (
        lambda a: a.agg(F.count("*").alias("arcs"), F.countDistinct("src").alias("vertices"), (F.min("w") >= 0).alias("positive")).join(F.broadcast(graph.asymmetric(a).agg((F.count("*") == 0).alias("symmetric"))))
    )(generators.scale_free(s, 2000, 3))
)
query("random_weights_symmetric", f"with {arcs_sql(TRADE)} select src, dst, true as same from arcs")(lambda s, d: _random_weights(s, d))


def _random_weights(spark, d):
    arcs = generators.random_weights(_trade_arcs(spark, d))
    back = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("x"))
    return arcs.join(back, ["src", "dst"]).select("src", "dst", ((F.col("w") == F.col("x")) & F.col("w").between(0, 1)).alias("same"))
