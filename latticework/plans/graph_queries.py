"""Registered queries of the graph operators, over the bridge's nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.model import ALL_EDGES, CODE_EDGES, SERVICE_EDGES, kinds_of, mask_of
from latticework.operators import graph, matching, traverse
from latticework.plans import bridge
from latticework.plans.registry import query

N, E = bridge.oracle(bridge.NODES), bridge.oracle(bridge.EDGES)
WITH = f"with recursive n as ({N}), e as ({E})"
CUSTOMER, SUPPLIER, ORDER = 3_000_000_000, 1_000_000_000, 4_000_000_000
CALLS_EXPOSES = mask_of(1, 4)


def _reach_sql(seeds: list[int], mask: int, depth: int, direction: str = "down") -> str:
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    first = " union all ".join(f"select cast({s} as bigint) as node, 0 as depth" for s in seeds)
    kinds = ",".join(map(str, kinds_of(mask)))
    return f"""{WITH}, w(node, depth) as ({first} union select {b}, depth + 1 from w join e on w.node = e.{a} where kind in ({kinds}) and depth < {depth}),
      r as (select node, min(depth) as depth from w group by node)"""


@query(_reach_sql([CUSTOMER], CALLS_EXPOSES, 6) + " select node, depth from r")
def bfs_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach(bridge.edges(spark, sf_dir), traverse.seeds_of(spark, [CUSTOMER]), CALLS_EXPOSES, 6)


@query(_reach_sql([7_000_000_000], ALL_EDGES, 2, "up") + " select node, depth from r")
def bfs_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach(bridge.edges(spark, sf_dir), traverse.seeds_of(spark, [7_000_000_000]), ALL_EDGES, 2, "up")


@query(_reach_sql([SUPPLIER + 3], SERVICE_EDGES, 8) + " select node, depth from r")
def bfs_service_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach(bridge.edges(spark, sf_dir), traverse.seeds_of(spark, [SUPPLIER + 3]), SERVICE_EDGES, 8)


@query(_reach_sql([CUSTOMER + 1, CUSTOMER + 7, SUPPLIER], CODE_EDGES, 4) + " select node, depth from r")
def bfs_multi_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach(bridge.edges(spark, sf_dir), traverse.seeds_of(spark, [CUSTOMER + 1, CUSTOMER + 7, SUPPLIER]), CODE_EDGES, 4)


@query(_reach_sql([SUPPLIER], mask_of(0, 1, 3), 3) + f" select node, depth, name, kind, repo from r join n on n.id = r.node where node <> {SUPPLIER}")
def depends_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.depends(bridge.edges(spark, sf_dir), SUPPLIER, mask_of(0, 1, 3), 3)
    return found.join(bridge.nodes(spark, sf_dir), F.col("node") == F.col("id")).select("node", "depth", "name", "kind", "repo")


@query(_reach_sql([ORDER + 5], ALL_EDGES, 3, "up") + f" select node, depth from r where node <> {ORDER + 5}")
def depends_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.depends(bridge.edges(spark, sf_dir), ORDER + 5, ALL_EDGES, 3, "up")


@query(_reach_sql([CUSTOMER + 2], CODE_EDGES, 7) + " select depth, count(*) as n from r group by depth")
def path_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = traverse.path_tree(bridge.edges(spark, sf_dir), traverse.seeds_of(spark, [CUSTOMER + 2]), CODE_EDGES, 7)
    return tree.groupBy("depth").agg(F.count("*").alias("n"))


@query(
    f"""{WITH}, back(node, d) as (select cast({CUSTOMER + 77} as bigint), 0 union select e.src, d + 1 from back join e on e.dst = back.node where kind in (1, 2) and d < 10),
    dist as materialized (select node, min(d) as d from back group by node),
    nx as materialized (select e.src as node, min(struct_pack(k := e.kind, n := e.dst)) as step from e join dist a on a.node = e.src join dist b on b.node = e.dst and b.d = a.d - 1 where kind in (1, 2) group by e.src),
    p(hop, node) as (select 0, node from dist where node = {CUSTOMER} union all select hop + 1, nx.step.n from p join nx on nx.node = p.node where p.node <> {CUSTOMER + 77})
    select hop, p.node, case when p.node <> {CUSTOMER + 77} then nx.step.k end as kind_to_next from p left join nx on nx.node = p.node"""
)
def path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.find_path(bridge.edges(spark, sf_dir), CUSTOMER, CUSTOMER + 77, CODE_EDGES, 10)


@query(_reach_sql([CUSTOMER + 4], mask_of(1, 4, 5), 4) + " select node, depth from r where node not in (select src from e where kind in (1, 4, 5))")
def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.terminals(bridge.edges(spark, sf_dir), CUSTOMER + 4, mask_of(1, 4, 5), 4).select("node", "depth")


@query(
    _reach_sql([ORDER + 9], ALL_EDGES, 3, "up")
    + f""" select node, depth from r join n on n.id = r.node where node <> {ORDER + 9}
    and (repo <> (select repo from n where id = {ORDER + 9}) or kind = 1 or (kind = 3 and node not in (select dst from e)))"""
)
def upstream_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.upstream_sources(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir), ORDER + 9, 3).select("node", "depth")


@query()
def upstream_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.upstream_paths(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir), ORDER + 9, 3).select("rank", F.array_join("nodes", ">").alias("path"))


_SUMMARY = """, up(id, cur, ckind) as (select id, id, kind from n union all select up.id, p.id, p.kind from up join n c on c.id = up.cur join n p on p.id = c.parent where up.ckind not in (1, 7)),
  a as (select id, cur as ancestor from up where ckind in (1, 7)),
  s as (select distinct x.ancestor as src, y.ancestor as dst from e join a x on x.id = e.src join a y on y.id = e.dst where x.ancestor <> y.ancestor)"""


@query(f"{WITH} {_SUMMARY} select src, dst from s")
def summary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary_edges(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir)).select("src", "dst")


@query(f"{WITH} {_SUMMARY}, w(node, depth) as (select cast({SUPPLIER} as bigint), 0 union select dst, depth + 1 from w join s on s.src = w.node where depth < 2) select node, min(depth) as depth from w group by node")
def summary_depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.summary_edges(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir))
    return traverse.reach(edges, traverse.seeds_of(spark, [SUPPLIER]), SERVICE_EDGES, 2)


@query(f"{WITH}, up(id, hops, ancestor) as (select id, 1, parent from n where parent is not null union all select up.id, hops + 1, n.parent from up join n on n.id = up.ancestor where n.parent is not null and hops < 10) select id, hops, ancestor from up")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(bridge.nodes(spark, sf_dir), 10)


@query(f"{WITH}, up(id, cur, ckind) as (select id, id, kind from n union all select up.id, p.id, p.kind from up join n c on c.id = up.cur join n p on p.id = c.parent where up.ckind not in (1, 7)) select id, cur as ancestor from up where ckind in (1, 7)")
def nearest_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_ancestor(bridge.nodes(spark, sf_dir), graph.SUMMARY_KINDS)


@query(
    f"""{WITH}, o as (select max(id) + 1 as o from n where kind in (0, 2)), b as (select * from n where kind in (1, 3))
    select id, name, coalesce(parent, -1) as parent from n where kind in (0, 2) union all select id + o, name, coalesce(parent + o, -1) from b cross join o"""
)
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir)
    merged, _ = graph.merge_graphs([(nodes.where("kind in (0, 2)"), edges.where("false")), (nodes.where("kind in (1, 3)"), edges.where("kind = 1"))])
    return merged.select("id", "name", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query(bridge.oracle("select 1000000000 + l_suppkey as src, 7000000000 + l_partkey as dst, 8 as kind, cast(max((l_linenumber * 36) % 256) as int) as confidence, bit_or(case when l_quantity > 25 then 1 else 4 end) as flags from {lineitem} group by l_suppkey, l_partkey"))
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bridge.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") + 1_000_000_000).alias("src"), (F.col("l_partkey") + 7_000_000_000).alias("dst"), F.lit(8).alias("kind"),
        ((F.col("l_linenumber") * 36) % 256).alias("confidence"), F.when(F.col("l_quantity") > 25, 1).otherwise(4).alias("flags"),
    )
    return graph.dedup_edges(raw)


_PART_NODES = "select p_partkey as id, cast(case p_partkey % 3 when 0 then 7 when 1 then 3 else 1 end as int) as kind, p_type as name, cast(case when p_partkey % 5 = 0 then null else concat('f', cast(p_partkey % 2 as varchar(9))) end as varchar(9)) as file, cast(p_partkey % 4 as int) as repo from {part}"


@query(
    f"""with n as ({bridge.oracle(_PART_NODES)}), k as (select id, case when kind = 3 then 'id' || id when file is null then kind || '|' || name || '|'
      when kind = 7 then kind || '|' || name || '|f:' || file else kind || '|' || name || '|r:' || repo end as key from n)
    select id, min(id) over (partition by key) as kept from k"""
)
def node_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_mapping(bridge.frame(spark, sf_dir, _PART_NODES))


@query(f"{WITH} select kind, count(*) as n, min(id) as first_id, max(id) as last_id from n group by kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kind_counts(bridge.nodes(spark, sf_dir))


@query(f"{WITH} select id, row_number() over (order by kind, name, repo, id) - 1 as number from n")
def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bridge.nodes(spark, sf_dir).withColumn("file", F.lit(None).cast("string")).withColumn("line", F.lit(0))
    return graph.numbered(nodes)


@query(f"{WITH} select id, (select count(*) from e where src = id) as n_out, (select count(*) from e where dst = id) as n_in from n")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir))


X = bridge.oracle(bridge.ENV_EDGES, edges=bridge.EDGES)
VARS = "select distinct dst as node from x where kind = 6 and dst % 2 = 0"


def _env(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = bridge.frame(spark, sf_dir, bridge.ENV_EDGES, edges=bridge.EDGES)
    return edges, edges.where("kind = 6 and dst % 2 = 0").select(F.col("dst").alias("node")).distinct()


@query(f"with x as ({X}), v as ({VARS}) select distinct c.dst as src, f.dst as dst from x c join x f on c.src = f.src and c.kind = 8 and f.kind = 6 join v on v.node = f.dst")
def resolves_same_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.resolves_same_function(*_env(spark, sf_dir))


@query(
    f"""with recursive x as ({X}), v as ({VARS}), w(origin, node, d) as (select distinct src, src, 0 from x where kind = 8 union select origin, x.src, d + 1 from w join x on x.dst = w.node and x.kind = 1 where d < 5),
    m as (select origin, node, min(d) as d from w group by origin, node)
    select distinct c.dst as src, f.dst as dst from m join x f on f.src = m.node and f.kind = 6 join v on v.node = f.dst join x c on c.src = m.origin and c.kind = 8 where m.d > 0"""
)
def resolves_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.resolves_backward(*_env(spark, sf_dir))


@query(
    f"""with recursive x as ({X}), v as ({VARS}), q as (select f.src, f.dst from x f join v on v.node = f.dst where f.kind = 6 and f.src not in (select src from x where kind = 8)),
    w(origin, node, d) as (select distinct src, src, 0 from q union select origin, x.dst, d + 1 from w join x on x.src = w.node and x.kind = 1 where d < 5),
    m as (select origin, node, min(d) as d from w group by origin, node)
    select distinct c.dst as src, q.dst as dst from m join x c on c.src = m.node and c.kind = 8 join q on q.src = m.origin where m.d > 0"""
)
def resolves_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.resolves_forward(*_env(spark, sf_dir))


@query(f"{WITH} select distinct src as caller from e where kind = 1 and dst = {CUSTOMER + 50} order by 1 limit 10")
def caller_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.callers(bridge.edges(spark, sf_dir), CUSTOMER + 50)


@query(
    _reach_sql([CUSTOMER + 2], CODE_EDGES, 2)
    + """, reached as (select node, kind from r join n on n.id = r.node where node <> 3000000002)
    select 'symbol' as class, count(*) as n from reached where kind = 3
    union all select 'service', count(distinct parent) from reached join n on n.id = reached.node where reached.kind = 3"""
)
def impact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = bridge.edges(spark, sf_dir).where("kind in (1, 2)")
    return traverse.impact_classes(bridge.nodes(spark, sf_dir), edges, CUSTOMER + 2, 2).groupBy("class").agg(F.count("*").alias("n"))


@query(_reach_sql([7_000_000_003], ALL_EDGES, 2, "up") + " select kind, count(*) as n from r join n on n.id = r.node where node <> 7000000003 group by kind")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impact(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir), 7_000_000_003, 2)


_SYMS = "select o_orderkey as id, 3 as kind, concat('f', cast(o_custkey % 30 as varchar(9))) as file, cast(o_orderkey % 700 as int) as line from {orders}"


@query(f"with s as ({bridge.oracle(_SYMS)}), a as (select file, line, lead(line) over (partition by file order by line) as next_line from (select distinct file, line from s) d) select id, file, line, coalesce(next_line, -1) as next_line from s join a using (file, line)")
def function_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.function_ranges(bridge.frame(spark, sf_dir, _SYMS))
    return found.select("id", "file", "line", F.coalesce("next_line", F.lit(-1)).alias("next_line"))


@query(f"{WITH} select a.name as caller, b.name as callee from e join n a on a.id = e.src join n b on b.id = e.dst where e.kind = 1")
def call_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.call_names(bridge.edges(spark, sf_dir), bridge.nodes(spark, sf_dir))


@query(f"{WITH} select count(*) as resolved, (select count(*) from e where dst not in (select id from n where kind <> 7)) as dangling from e where dst in (select id from n where kind <> 7)")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, known = bridge.edges(spark, sf_dir), bridge.nodes(spark, sf_dir).where("kind <> 7").select(F.col("id").alias("dst"))
    return graph.completeness(edges.join(known, "dst", "left_semi"), edges.join(known, "dst", "left_anti")).select("resolved", "dangling")


@query(f"{WITH} select dst as id, min(src) as parent from e where kind = 0 group by dst")
def derived_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bridge.nodes(spark, sf_dir).withColumn("parent", F.lit(None).cast("bigint"))
    return graph.derived_parents(nodes, bridge.edges(spark, sf_dir)).where("parent is not null").select("id", "parent")


@query(f"{WITH} select 'self' as relation, -1 as kind, {SUPPLIER} as id union select 'ancestor', -1, parent from n where id = {SUPPLIER} union select 'ancestor', -1, p.parent from n join n p on p.id = n.parent where n.id = {SUPPLIER} union select 'to', kind, dst from e where src = {SUPPLIER} union select 'from', kind, src from e where dst = {SUPPLIER}")
def node_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.context(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir), SUPPLIER)
    return found.select("relation", F.coalesce("kind", F.lit(-1)).alias("kind"), "id")
