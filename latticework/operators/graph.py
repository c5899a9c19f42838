"""Building, deduplicating and merging graphs, and what follows from their nodes' parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.model import EdgeKind, NodeKind, in_mask
from latticework.storage import stored


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, kind, dst): its highest confidence, all its flags."""
    return edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.bit_or("flags").alias("flags"))


def node_key(kind: Column, name: Column, file: Column, repo: Column) -> Column:
    """What makes two nodes one: without a file the kind and name; endpoints and resources by file; deployables and modules by repo; null for symbols, which stay apart."""
    by_file = kind.isin(int(NodeKind.ENDPOINT), int(NodeKind.RESOURCE))
    by_repo = kind.isin(int(NodeKind.DEPLOYABLE), int(NodeKind.MODULE))
    part = F.when(file.isNull(), F.lit("")).when(by_file, F.concat(F.lit("f:"), file)).when(by_repo, F.concat(F.lit("r:"), repo.cast("string")))
    return F.when(kind != int(NodeKind.SYMBOL), F.when(part.isNotNull(), F.struct(kind.alias("kind"), name.alias("name"), part.alias("part"))))


def node_mapping(nodes: DataFrame) -> DataFrame:
    """id and kept: the smallest id among nodes that are one."""
    keyed = nodes.select("id", node_key(F.col("kind"), F.col("name"), F.col("file"), F.col("repo")).alias("key"))
    least = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("kept"))
    return keyed.join(least, "key", "left").select("id", F.coalesce("kept", "id").alias("kept"))


def dedup_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are one become one, and edges and parents follow; edges are then deduplicated too."""
    mapping = stored(node_mapping(nodes), "node-map")
    kept = nodes.join(mapping.where("id = kept").select("id"), "id", "left_semi")
    parents = mapping.select(F.col("id").alias("parent"), F.col("kept").alias("kept_parent"))
    kept = kept.join(parents, "parent", "left").withColumn("parent", F.coalesce("kept_parent", "parent")).select(nodes.columns)
    ends = [mapping.select(F.col("id").alias(c), F.col("kept").alias(f"kept_{c}")) for c in ("src", "dst")]
    moved = edges.join(ends[0], "src").join(ends[1], "dst").drop("src", "dst").withColumnsRenamed({"kept_src": "src", "kept_dst": "dst"})
    return kept, dedup_edges(moved)


def numbered(nodes: DataFrame) -> DataFrame:
    """id and number, 0, 1, ... in the order of kind, name, repo, file and line.

    Counts of range partitions place each partition, so no task orders more than its own part.
    """
    order = ["kind", "name", "repo", "file", "line", "id"]
    parts = stored(nodes.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "node-order")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return parts.withColumn("place", F.row_number().over(inside)).join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("place") - 1).alias("number"))  # starts: a row for each partition


def merge_graphs(graphs: list[tuple[DataFrame, DataFrame]], extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several graphs as one: the ids of each graph go behind those of the ones before. Nodes are not deduplicated; edges are."""
    offsets, start = [], 0
    for nodes, _ in graphs:
        offsets.append(start)
        start += (nodes.agg(F.max("id")).first()[0] or -1) + 1 if not nodes.isEmpty() else 0
    moved_nodes = [n.withColumn("id", F.col("id") + o).withColumn("parent", F.col("parent") + o) for (n, _), o in zip(graphs, offsets, strict=True)]
    moved_edges = [e.withColumn("src", F.col("src") + o).withColumn("dst", F.col("dst") + o) for (_, e), o in zip(graphs, offsets, strict=True)]
    nodes = reduce(DataFrame.unionByName, moved_nodes)
    edges = reduce(DataFrame.unionByName, moved_edges + ([extra] if extra is not None else []))
    return nodes, dedup_edges(edges)


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_out and n_in of every node."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    zero = F.lit(0).cast("long")
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


def derived_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the parent that a Contains edge gives them, where they have none; of several the smallest."""
    owner = edges.where(F.col("kind") == int(EdgeKind.CONTAINS)).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("owner"))
    return nodes.join(owner, "id", "left").withColumn("parent", F.coalesce("parent", "owner")).select(nodes.columns)


# ---- ancestors ------------------------------------------------------------------------------------------------------------------


def nearest_ancestor(nodes: DataFrame, kinds: list[int], most_hops: int = 1 << 30) -> DataFrame:
    """id and ancestor: the node itself if it is of the kinds, else the nearest one above it; nodes without one have no row.

    Pointers double: after k rounds a node has looked 2**k hops up, so deep trees need few rounds, and a cycle of parents ends.
    """
    state = nodes.select("id", F.when(F.col("kind").isin(kinds), F.col("id")).alias("ancestor"), F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("up"))
    state = stored(state, "ancestors")
    hops = 1
    while hops < most_hops:
        above = state.select(F.col("id").alias("a_id"), F.col("ancestor").alias("a_ancestor"), F.col("up").alias("a_up"))
        open_ = state.where("ancestor is null and up is not null")
        if open_.isEmpty():
            break
        step = open_.join(above, F.col("up") == F.col("a_id"), "left").select("id", F.col("a_ancestor").alias("ancestor"), F.when(F.col("a_ancestor").isNull(), F.col("a_up")).alias("up"))
        done = state.where("ancestor is not null or up is null")
        state, hops = stored(done.unionByName(step), "ancestors"), hops * 2
    return state.where("ancestor is not null").select("id", "ancestor")


def ancestors(nodes: DataFrame, most_hops: int, only: int | None = None) -> DataFrame:
    """id, hops and ancestor of every node's (or only one's) chain of parents, up to most_hops; a node that is its own ancestor ends a chain."""
    parents = stored(nodes.where("parent is not null and parent <> id").select(F.col("id").alias("p_id"), "parent"), "parents")
    level = parents.select(F.col("p_id").alias("id"), F.lit(1).alias("hops"), F.col("parent").alias("ancestor"))
    level = level if only is None else level.where(F.col("id") == only)
    levels = [level]
    for hops in range(2, most_hops + 1):
        level = stored(level.join(parents, F.col("ancestor") == F.col("p_id")).where(F.col("parent") != F.col("id")).select("id", F.lit(hops).alias("hops"), F.col("parent").alias("ancestor")), "chain")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


SUMMARY_KINDS = [int(NodeKind.DEPLOYABLE), int(NodeKind.RESOURCE)]


def summary_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src and dst: deployables and resources between whose parts any edge runs, one DependsOn for each pair."""
    of = stored(nearest_ancestor(nodes, SUMMARY_KINDS), "summary-of")
    pairs = edges.select("src", "dst").join(of.select(F.col("id").alias("src"), F.col("ancestor").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("ancestor").alias("b")), "dst")
    return pairs.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().withColumn("kind", F.lit(int(EdgeKind.DEPENDS_ON)).cast("tinyint"))


def summary_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(SUMMARY_KINDS)).withColumn("parent", F.lit(None).cast("bigint"))


def completeness(edges: DataFrame, dangling: DataFrame) -> DataFrame:
    """One row: resolved, dangling and resolved / (resolved + dangling), 1 for none at all."""
    both = edges.agg(F.count("*").alias("resolved")).crossJoin(F.broadcast(dangling.agg(F.count("*").alias("dangling"))))  # one row each
    total = F.col("resolved") + F.col("dangling")
    return both.withColumn("completeness", F.when(total == 0, 1.0).otherwise(F.col("resolved") / total))


def gaps(nodes: DataFrame, edges: DataFrame, reached: DataFrame, mask: int) -> DataFrame:
    """src, dst and kind of the mask's edges that lead from what has been reached (column node) to no known node."""
    out = edges.where(in_mask(F.col("kind"), mask)).join(reached.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return out.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "kind").distinct()
