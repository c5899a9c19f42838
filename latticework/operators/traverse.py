"""Reachability, shortest paths and what is built on them: loops of joins over a frontier.

Each level joins the frontier with the edges, drops what has been visited and is written to the shared folder, so neither the plan nor the
loss of an executor grows with depth. A frontier of few rows is broadcast, by its count; larger ones are joined by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.model import ALL_EDGES, EdgeKind, NodeKind, in_mask, mask_of
from latticework.operators.graph import ancestors, nearest_ancestor
from latticework.storage import small, stored

DOWN, UP = "down", "up"


def directed(edges: DataFrame, mask: int = ALL_EDGES, direction: str = DOWN) -> DataFrame:
    """here, there and kind of the mask's edges, as they are walked; the filter stands before the loop, where the scan can use it."""
    a, b = ("src", "dst") if direction == DOWN else ("dst", "src")
    return stored(edges.where(in_mask(F.col("kind"), mask)).select(F.col(a).alias("here"), F.col(b).alias("there"), F.col("kind").cast("int").alias("kind")), "walk-edges")


def seeds_of(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


def reach(edges: DataFrame, seeds: DataFrame, mask: int = ALL_EDGES, max_depth: int = 20, direction: str = DOWN, by: tuple[str, ...] = ()) -> DataFrame:
    """node and depth of all that the seeds (column node) reach in at most max_depth steps, the seeds at depth 0 included.

    by: further columns of seeds that keep walks apart, such as where each began.
    """
    walk = directed(edges, mask, direction)
    key = [*by, "node"]
    level = stored(seeds.select(*key).distinct(), "walk-level")
    visited = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        n = level.count()
        if not n:
            break
        seen = reduce(DataFrame.unionByName, visited).select(*key)
        step = small(level, n).join(walk, level["node"] == walk["here"]).select(*(level[c] for c in by), F.col("there").alias("node")).distinct()
        level = stored(step.join(seen, key, "left_anti"), "walk-level")
        visited.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, visited)


def depends(edges: DataFrame, seed: int, mask: int = ALL_EDGES, max_depth: int = 20, direction: str = DOWN) -> DataFrame:
    """What a node reaches, without itself."""
    return reach(edges, seeds_of(edges.sparkSession, [seed]), mask, max_depth, direction).where(F.col("node") != seed)


def path_tree(edges: DataFrame, seeds: DataFrame, mask: int = ALL_EDGES, max_depth: int = 20, direction: str = DOWN) -> DataFrame:
    """node, depth and path of everything reached: path is the (kind, node) steps of the shortest walk.

    Of several shortest walks it is the one that a queue would find: the earliest parent, then the smallest kind. Comparing the walks
    step by step gives that order, so no global numbering of the frontier is needed.
    """
    walk = directed(edges, mask, direction)
    start = F.array().cast("array<struct<kind:int,node:bigint>>")
    level = stored(seeds.select("node").distinct().withColumn("path", start), "path-level")
    visited = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        n = level.count()
        if not n:
            break
        seen = reduce(DataFrame.unionByName, visited).select("node")
        step = small(level, n).join(walk, level["node"] == walk["here"])
        step = step.select(F.col("there").alias("node"), F.array_append("path", F.struct("kind", F.col("there").alias("node"))).alias("path"))
        best = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        level = stored(best, "path-level")
        visited.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, visited)


def find_path(edges: DataFrame, source: int, target: int, mask: int = ALL_EDGES, max_depth: int = 20, direction: str = DOWN) -> DataFrame:
    """hop, node and kind_to_next of the shortest path, in order; no rows if there is none within max_depth."""
    found = path_tree(edges, seeds_of(edges.sparkSession, [source]), mask, max_depth, direction).where(F.col("node") == target)
    nodes = F.concat(F.array(F.lit(source).cast("bigint")), F.transform("path", lambda s: s["node"]))
    hops = found.select(F.posexplode(nodes).alias("hop", "node"), "path")
    return hops.select("hop", "node", F.get(F.transform("path", lambda s: s["kind"]), F.col("hop")).alias("kind_to_next"))


def terminals(edges: DataFrame, source: int, mask: int = ALL_EDGES, max_depth: int = 20) -> DataFrame:
    """path_tree() rows of reached nodes, the source included, that no edge of the mask leaves."""
    tree = path_tree(edges, seeds_of(edges.sparkSession, [source]), mask, max_depth)
    leaving = edges.where(in_mask(F.col("kind"), mask)).select(F.col("src").alias("node")).distinct()
    return tree.join(leaving, "node", "left_anti")


def upstream_sources(nodes: DataFrame, edges: DataFrame, start: int, max_depth: int = 20) -> DataFrame:
    """path_tree() rows, walked against the edges, of where calls to start come from.

    Those are nodes of another repo, deployables, and symbols that nothing leads to. Without any, nodes into which nothing unvisited
    leads; without those either, the last level.
    """
    tree = stored(path_tree(edges, seeds_of(edges.sparkSession, [start]), ALL_EDGES, max_depth, UP), "upstream")
    reached = tree.where(F.col("node") != start)
    home = nodes.where(F.col("id") == start).select("repo").first()
    entered = edges.select(F.col("dst").alias("node")).distinct().withColumn("entered", F.lit(True))
    known = reached.join(nodes.select(F.col("id").alias("node"), "kind", "repo"), "node").join(entered, "node", "left")
    bare_symbol = (F.col("kind") == int(NodeKind.SYMBOL)) & F.col("entered").isNull()
    other_repo = ~F.col("repo").eqNullSafe(F.lit(home["repo"] if home else None))
    found = known.where(other_repo | (F.col("kind") == int(NodeKind.DEPLOYABLE)) | bare_symbol).select(tree.columns)
    if not found.isEmpty():
        return found
    outside = edges.select(F.col("src").alias("s"), F.col("dst").alias("node")).join(tree.select(F.col("node").alias("s")), "s", "left_anti").select("node")
    closed = reached.join(outside, "node", "left_anti")
    if not closed.isEmpty():
        return closed
    last = reached.agg(F.max("depth")).first()[0]
    return reached.where(F.col("depth") == F.lit(last))


def upstream_paths(nodes: DataFrame, edges: DataFrame, start: int, max_depth: int = 20, most: int = 20) -> DataFrame:
    """rank and nodes, from the source to start: the longest first, without those that end a longer one, most of them."""
    found = upstream_sources(nodes, edges, start, max_depth)
    whole = F.concat(F.reverse(F.transform("path", lambda s: s["node"])), F.array(F.lit(start).cast("bigint")))
    paths = stored(found.select(whole.alias("nodes")).distinct(), "upstream-paths")
    ends = paths.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("nodes")), lambda k: F.slice("nodes", k, F.size("nodes")))).alias("nodes")).distinct()
    alone = paths.where(F.size("nodes") > 1).join(ends, "nodes", "left_anti")
    ranked = alone.orderBy(F.size("nodes").desc(), "nodes").limit(most)
    return ranked.select(F.row_number().over(Window.orderBy(F.size("nodes").desc(), "nodes")).alias("rank"), "nodes")


def callers(edges: DataFrame, target: int, most: int = 10) -> DataFrame:
    """caller: the first of those that call the target."""
    found = edges.where((F.col("kind") == int(EdgeKind.CALLS)) & (F.col("dst") == target))
    return found.select(F.col("src").alias("caller")).distinct().orderBy("caller").limit(most)


# ---- Resolves edges -------------------------------------------------------------------------------------------------------------

CALLS_ONLY = mask_of(EdgeKind.CALLS)
RESOLVE_DEPTH = 5


def resolves_same_function(edges: DataFrame, variables: DataFrame) -> DataFrame:
    """src (what a symbol connects to) and dst (an address variable that the same symbol is configured by). variables: node, the address variables."""
    connects = edges.where(F.col("kind") == int(EdgeKind.CONNECTS)).select(F.col("src").alias("at"), F.col("dst").alias("target"))
    configures = edges.where(F.col("kind") == int(EdgeKind.CONFIGURES)).select(F.col("src").alias("at"), F.col("dst").alias("node")).join(variables, "node", "left_semi")
    return connects.join(configures, "at").select(F.col("target").alias("src"), F.col("node").alias("dst")).distinct()


def resolves_backward(edges: DataFrame, variables: DataFrame, max_depth: int = RESOLVE_DEPTH) -> DataFrame:
    """src and dst as above, where the variable is read by a caller, max_depth calls up at most, of the symbol that connects."""
    connects = edges.where(F.col("kind") == int(EdgeKind.CONNECTS)).select(F.col("src").alias("node"), F.col("dst").alias("target"))
    up = reach(edges, connects.select("node", F.col("node").alias("origin")).distinct(), CALLS_ONLY, max_depth, UP, by=("origin",)).where("depth > 0")
    reads = edges.where(F.col("kind") == int(EdgeKind.CONFIGURES)).select(F.col("src").alias("node"), F.col("dst").alias("var")).join(variables.select(F.col("node").alias("var")), "var", "left_semi")
    return up.join(reads, "node").join(connects.select(F.col("node").alias("origin"), "target"), "origin").select(F.col("target").alias("src"), F.col("var").alias("dst")).distinct()


def resolves_forward(edges: DataFrame, variables: DataFrame, max_depth: int = RESOLVE_DEPTH) -> DataFrame:
    """src and dst as above, where a symbol that reads the variable and connects to nothing calls, max_depth calls down at most, one that connects."""
    connects = edges.where(F.col("kind") == int(EdgeKind.CONNECTS)).select(F.col("src").alias("node"), F.col("dst").alias("target"))
    reads = edges.where(F.col("kind") == int(EdgeKind.CONFIGURES)).select(F.col("src").alias("node"), F.col("dst").alias("var")).join(variables.select(F.col("node").alias("var")), "var", "left_semi")
    readers = reads.join(connects.select("node"), "node", "left_anti")
    down = reach(edges, readers.select("node", F.col("node").alias("origin")).distinct(), CALLS_ONLY, max_depth, DOWN, by=("origin",)).where("depth > 0")
    return down.join(connects, "node").join(readers.select(F.col("node").alias("origin"), "var"), "origin").select(F.col("target").alias("src"), F.col("var").alias("dst")).distinct()


# ---- impact ---------------------------------------------------------------------------------------------------------------------


def impact(nodes: DataFrame, edges: DataFrame, seed: int, max_depth: int = 5) -> DataFrame:
    """kind and n: what depends on a node, by kind."""
    return depends(edges, seed, ALL_EDGES, max_depth, UP).join(nodes.select(F.col("id").alias("node"), "kind"), "node").groupBy("kind").agg(F.count("*").alias("n"))


def impact_classes(nodes: DataFrame, edges: DataFrame, seed: int, max_depth: int = 20, direction: str = DOWN) -> DataFrame:
    """class, id and detail of what a change of a node can touch, from one walk.

    symbol, endpoint and resource: what is reached, by kind. service: the deployables that hold a reached symbol, or are reached. config:
    what configures such a service or what it holds, with the service as detail. skew: the services, where the seed is a surface that more
    than one of them depends on, so that they can run different versions of it.
    """
    reached = stored(depends(edges, seed, ALL_EDGES, max_depth, direction), "impact")
    known = reached.join(nodes.select(F.col("id").alias("node"), "kind"), "node")
    names = {int(NodeKind.SYMBOL): "symbol", int(NodeKind.ENDPOINT): "endpoint", int(NodeKind.RESOURCE): "resource"}
    labels = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    none = F.lit(None).cast("bigint").alias("detail")
    direct = known.where(F.col("kind").isin(list(names))).select(F.element_at(labels, F.col("kind").cast("int")).alias("class"), F.col("node").alias("id"), none)
    holders = stored(nearest_ancestor(nodes, [int(NodeKind.DEPLOYABLE)]), "holders")  # a deployable holds itself
    touched = known.where(F.col("kind").isin(int(NodeKind.SYMBOL), int(NodeKind.DEPLOYABLE))).select(F.col("node").alias("id"))
    services = stored(holders.join(touched, "id", "left_semi").select(F.col("ancestor").alias("service")).distinct(), "services")
    parts = holders.join(services, holders["ancestor"] == services["service"], "left_semi").select(F.col("id").alias("dst"), F.col("ancestor").alias("service"))
    configures = edges.where(F.col("kind") == int(EdgeKind.CONFIGURES))
    into = configures.join(parts, "dst").select(F.col("src").alias("id"), F.col("service").alias("detail"))
    out_of = configures.join(parts.withColumnRenamed("dst", "src"), "src").select(F.col("dst").alias("id"), F.col("service").alias("detail"))
    config = into.union(out_of).distinct().select(F.lit("config").alias("class"), "id", "detail")
    is_surface = not nodes.where((F.col("id") == seed) & (F.col("kind") == int(NodeKind.SURFACE))).isEmpty()
    found = direct.unionByName(services.select(F.lit("service").alias("class"), F.col("service").alias("id"), none)).unionByName(config)
    if is_surface and services.count() > 1:
        found = found.unionByName(services.select(F.lit("skew").alias("class"), F.col("service").alias("id"), F.lit(seed).cast("bigint").alias("detail")))
    return found


def context(nodes: DataFrame, edges: DataFrame, node: int) -> DataFrame:
    """relation, kind and id around a node: itself, its ancestors, and its neighbours by edges in both directions."""
    up = {r.hops: r.ancestor for r in ancestors(nodes, 10, node).collect()}  # ten rows at most
    above = [("ancestor", None, up[h]) for h in sorted(up)]
    own = nodes.sparkSession.createDataFrame([("self", None, node), *above], "relation string, kind int, id bigint")
    out = edges.where(F.col("src") == node).select(F.lit("to").alias("relation"), F.col("kind").cast("int").alias("kind"), F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == node).select(F.lit("from").alias("relation"), F.col("kind").cast("int").alias("kind"), F.col("src").alias("id"))
    return own.unionByName(out).unionByName(into).distinct()
