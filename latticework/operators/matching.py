"""Joins that resolve facts of one repository against those of others.

Each works on flat DataFrames with a repo column. Exact matches come first, and a fallback sees only what they left (an anti-join), so no
join condition holds an OR that would force a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import paths
from latticework.model import CROSS_REPO, EdgeKind, NodeKind, quantised

# Endpoint names that link nothing.
GENERIC_ENDPOINTS = ("websocket", "/", "/health", "/healthz", "health", "index")


def _prefixed(df: DataFrame, prefix: str, only: list[str] | None = None) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in (only or df.columns)))


def _same_repo(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


# ---- gRPC -----------------------------------------------------------------------------------------------------------------------


def match_protos(stubs: DataFrame, registrations: DataFrame, protos: DataFrame) -> DataFrame:
    """Stubs and registrations of one service_name, with confidence and known (whether any proto file has the service).

    stubs and registrations: repo, service_name, file, line; protos: service_name.
    """
    a, b = _prefixed(stubs, "client"), _prefixed(registrations, "server")
    known = protos.select("service_name").distinct().withColumn("known", F.lit(True))
    met = a.join(b, F.col("client_service_name") == F.col("server_service_name")).withColumnRenamed("client_service_name", "service_name").drop("server_service_name")
    confidence = F.when(_same_repo("client_repo", "server_repo"), 0.5).otherwise(0.95)
    return met.join(known, "service_name", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("confidence", confidence)


def unresolved_stubs(stubs: DataFrame, registrations: DataFrame) -> DataFrame:
    return stubs.join(registrations.select("service_name").distinct(), "service_name", "left_anti")


# ---- REST and WebSocket ---------------------------------------------------------------------------------------------------------


def rest_exact(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls and routes (repo, path, method, file, line) of one normalised path, without trivial ones."""
    c, s = _rest_sides(calls, routes)
    met = c.join(s, "norm")
    agrees = (F.col("client_method") == "") | (F.col("server_method") == "") | (F.lower("client_method") == F.lower("server_method"))
    confidence = F.when(_same_repo("client_repo", "server_repo"), 0.4).when(agrees, 0.85).otherwise(0.6)
    return met.withColumn("confidence", confidence).withColumn("method", F.when(agrees, F.col("server_method")).otherwise(""))


def _rest_sides(calls: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = _prefixed(calls, "client").withColumn("norm", paths.rest_path(F.col("client_path"))).where(~paths.is_trivial(F.col("norm")))
    s = _prefixed(routes, "server").withColumn("norm", paths.rest_path(F.col("server_path"))).where(~paths.is_trivial(F.col("norm")))
    return c, s


def rest_prefix(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """For calls without an exact route: routes of which one path starts with the other, both of two segments or more."""
    c, s = _rest_sides(calls, routes)
    c = c.join(s.select("norm").distinct(), "norm", "left_anti")
    deep = paths.segments(F.col("norm")) >= paths.MIN_PREFIX_SEGMENTS
    left, right = c.where(deep).withColumnRenamed("norm", "client_norm"), s.where(deep).withColumnRenamed("norm", "server_norm")
    met = left.join(prefix_pairs(left, right), "client_norm").join(right, "server_norm")
    return met.withColumn("confidence", F.when(_same_repo("client_repo", "server_repo"), 0.3).otherwise(0.6)).withColumn("method", F.lit(""))


def match_rest(calls: DataFrame, routes: DataFrame) -> DataFrame:
    columns = ["server_path", "method", "client_file", "client_line", "client_repo", "server_file", "server_line", "server_repo", "confidence"]
    return rest_exact(calls, routes).select(*columns, F.lit(True).alias("exact")).unionByName(rest_prefix(calls, routes).select(*columns, F.lit(False).alias("exact")))


def match_websockets(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """clients: repo, url, file, line; servers: repo, path, file, line. A client without an exact path falls back to prefixes, of any depth."""
    c = _prefixed(clients, "client").withColumn("norm", paths.ws_norm(paths.ws_path(F.col("client_url")))).withColumn("in_cluster", paths.k8s_dns(F.col("client_url")).isNotNull())
    s = _prefixed(servers, "server").withColumn("norm", paths.ws_norm(paths.ws_path(F.col("server_path"))))
    same = _same_repo("client_repo", "server_repo")
    exact = c.join(s, "norm").withColumn("confidence", F.when(same, 0.4).when(F.col("in_cluster"), 0.85).otherwise(0.75)).withColumn("exact", F.lit(True))
    rest = c.join(s.select("norm").distinct(), "norm", "left_anti").withColumnRenamed("norm", "client_norm")
    targets = s.withColumnRenamed("norm", "server_norm")
    near = rest.join(prefix_pairs(rest, targets), "client_norm").join(targets, "server_norm")
    near = near.withColumn("confidence", F.when(same, 0.3).otherwise(0.5)).withColumn("exact", F.lit(False))
    columns = ["server_path", "client_url", "client_file", "client_line", "client_repo", "server_file", "server_line", "server_repo", "confidence", "exact"]
    return exact.select(columns).unionByName(near.select(columns))


def prefix_pairs(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """client_norm and server_norm, distinct, of which one starts with the other.

    Two equi-joins, of all beginnings of the one side's paths with the other side's whole paths: no two paths meet on a beginning that
    they merely share.
    """
    c, s = clients.select("client_norm").distinct(), servers.select("server_norm").distinct()
    shorter_server = c.withColumn("server_norm", F.explode(_heads(F.col("client_norm")))).join(s, "server_norm")
    shorter_client = s.withColumn("client_norm", F.explode(_heads(F.col("server_norm")))).join(c, "client_norm").where("client_norm <> server_norm")
    return shorter_server.select("client_norm", "server_norm").unionByName(shorter_client.select("client_norm", "server_norm"))


def _heads(path: Column) -> Column:
    """All beginnings of a path, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(path)), lambda k: F.substring(path, F.lit(1), k))


# ---- configuration --------------------------------------------------------------------------------------------------------------


def match_helm_env(reads: DataFrame, definitions: DataFrame) -> DataFrame:
    """reads: repo, var_name, file, line; definitions: the same with value. A value that is a cluster address counts more."""
    a, b = _prefixed(reads, "read"), _prefixed(definitions, "def")
    met = a.join(b, F.col("read_var_name") == F.col("def_var_name")).withColumnRenamed("read_var_name", "var_name").drop("def_var_name")
    return met.withColumn("k8s", paths.k8s_dns(F.col("def_value"))).withColumn("confidence", F.when(F.col("k8s").isNotNull(), 0.85).otherwise(0.7))


def match_env_services(reads: DataFrame, bindings: DataFrame) -> DataFrame:
    """reads: repo, var_name, file, line; bindings: var_name, value, file, line, deployment_name. Values that name no service drop out."""
    a, b = _prefixed(reads, "read"), _prefixed(bindings, "bound")
    met = a.join(b, F.col("read_var_name") == F.col("bound_var_name")).withColumnRenamed("read_var_name", "var_name").drop("bound_var_name")
    met = met.withColumn("to", paths.service_value(F.col("bound_value"))).where("to is not null")
    return met.withColumn("confidence", F.when(F.col("to.port").isNotNull(), 0.95).otherwise(0.80))


def match_images(built: DataFrame, used: DataFrame) -> DataFrame:
    """built: repo, image_ref, file; used: repo, image_ref, file, line. By the whole reference without its tag, else by the image's name alone."""
    b = _prefixed(built, "built").withColumn("path", paths.image_path(F.col("built_image_ref"))).withColumn("name", paths.image_name(F.col("built_image_ref")))
    u = _prefixed(used, "used").withColumn("path", paths.image_path(F.col("used_image_ref"))).withColumn("name", paths.image_name(F.col("used_image_ref")))
    exact = u.join(b.drop("name"), "path").withColumn("confidence", F.lit(0.95))
    left = u.join(b.select("path").distinct(), "path", "left_anti")
    by_name = left.drop("path").join(b.drop("path"), "name").withColumn("confidence", F.lit(0.7))
    columns = [*(f"built_{c}" for c in built.columns), *(f"used_{c}" for c in used.columns), "confidence"]
    return exact.select(columns).unionByName(by_name.select(columns))


# ---- the resolver ---------------------------------------------------------------------------------------------------------------


def resolution(**matches: DataFrame) -> DataFrame:
    """All matches with their type; columns that a type lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("type", F.lit(t)) for t, df in matches.items()])


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """type and n, and the total under the type 'total'."""
    return resolved.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


# ---- joins of nodes -------------------------------------------------------------------------------------------------------------


def first_by_name(nodes: DataFrame, kind: int = NodeKind.SYMBOL) -> DataFrame:
    return nodes.where(F.col("kind") == int(kind)).groupBy("name").agg(F.min("id").alias("target"))


def resolve_calls(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """src and dst of calls (caller, name) that a symbol of that name anywhere answers, the first, if it is not the caller."""
    met = unresolved.join(first_by_name(nodes), "name").where("caller <> target")
    return met.select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct()


def same_name_edges(nodes: DataFrame, kind: int, edge: EdgeKind, confidence: int = 255, skip: tuple[str, ...] = ()) -> DataFrame:
    """Edges both ways between nodes of a kind that have one name in different repos."""
    rows = nodes.where((F.col("kind") == int(kind)) & (F.length("name") > 1) & ~F.col("name").isin(*skip) if skip else F.col("kind") == int(kind)).select("id", "name", "repo")
    a, b = _prefixed(rows, "a"), _prefixed(rows, "b")
    met = a.join(b, (F.col("a_name") == F.col("b_name")) & (F.col("a_repo") != F.col("b_repo")))
    return met.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.lit(int(edge)).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(CROSS_REPO).alias("flags"))


# ---- as-of joins ----------------------------------------------------------------------------------------------------------------


def enclosing(sites: DataFrame, definitions: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """sites with definition, the id of the last definition at or before their line in the same file; the smallest id among equal lines.

    sites: by and line, and whatever else; definitions: by, line and id. Definitions and sites run through one window per file: no pairs
    are made, and a file of many sites costs one sort.
    """
    keys = [F.col(c) for c in by]
    defs = definitions.groupBy(*by, "line").agg(F.min("id").alias("definition"))
    rows = sites.withColumn("site", F.struct(*sites.columns)).select(*keys, "line", F.lit(None).cast(defs.schema["definition"].dataType).alias("definition"), "site", F.lit(1).alias("turn"))
    marks = defs.select(*keys, "line", "definition", F.lit(None).cast(rows.schema["site"].dataType).alias("site"), F.lit(0).alias("turn"))
    so_far = Window.partitionBy(*keys).orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(rows).withColumn("definition", F.last("definition", ignorenulls=True).over(so_far))
    return filled.where("turn = 1").select("site.*", "definition")


def match_edges(matches: DataFrame, definitions: DataFrame) -> DataFrame:
    """DependsOn edges of matches (client_repo, client_file, client_line, server_..., confidence): from and to the definitions that hold both sites."""
    client = matches.withColumns({"repo": F.col("client_repo"), "file": F.col("client_file"), "line": F.col("client_line")})
    placed = enclosing(client, definitions, ("repo", "file")).withColumnRenamed("definition", "src")
    server = placed.withColumns({"repo": F.col("server_repo"), "file": F.col("server_file"), "line": F.col("server_line")})
    ends = enclosing(server, definitions, ("repo", "file")).withColumnRenamed("definition", "dst").where("src <> dst")
    return ends.select("src", "dst", F.lit(int(EdgeKind.DEPENDS_ON)).alias("kind"), quantised(F.col("confidence")).alias("confidence"), F.lit(CROSS_REPO).alias("flags"))


# ---- registries -----------------------------------------------------------------------------------------------------------------


def overlay(index: DataFrame, calls_map: str, serves_map: str, kind: EdgeKind, confidence: int) -> DataFrame:
    """Edges both ways between entries (map_name, key, repo_id, file, line, symbol) that call and serve one key in different repos."""
    columns = ["key", "repo_id", "file", "line", "symbol"]
    a = _prefixed(index.where(F.col("map_name") == calls_map), "source", columns)
    b = _prefixed(index.where(F.col("map_name") == serves_map), "target", columns)
    met = a.join(b, (F.col("source_key") == F.col("target_key")) & (F.col("source_repo_id") != F.col("target_repo_id"))).drop("target_key").withColumnRenamed("source_key", "key")
    swapped = {f"{x}_{c}": f"{y}_{c}" for c in columns[1:] for x, y in (("source", "target"), ("target", "source"))}
    back = met.select(*(F.col(swapped.get(c, c)).alias(c) for c in met.columns))
    return met.unionByName(back).withColumns({"kind": F.lit(int(kind)), "confidence": F.lit(confidence), "flags": F.lit(CROSS_REPO)}).distinct()


def index_of(facts: DataFrame) -> DataFrame:
    """map_name, key and entries, an ordered list of (repo_id, repo_name, file, line, symbol): the index as a multimap."""
    return facts.groupBy("map_name", "key").agg(F.array_sort(F.collect_list(F.struct("repo_id", "repo_name", "file", "line", "symbol"))).alias("entries"))


def overlay_edges(stable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between ids of overlay() rows: each end is the last symbol, endpoint or surface at or before its line in its file, else one of its name."""
    known = nodes.where(F.col("kind").isin(int(NodeKind.SYMBOL), int(NodeKind.ENDPOINT), int(NodeKind.SURFACE)))
    defs = known.where("file is not null").select(F.col("repo").alias("repo_id"), "file", "line", "id")
    by_name = known.groupBy(F.col("repo").alias("repo_id"), F.col("name").alias("symbol")).agg(F.min("id").alias("named"))
    rows = stable
    for side, end in (("source", "src"), ("target", "dst")):
        site = rows.withColumns({c: F.col(f"{side}_{c}") for c in ("repo_id", "file", "line", "symbol")})
        met = enclosing(site, defs, ("repo_id", "file")).join(by_name, ["repo_id", "symbol"], "left")
        rows = met.withColumn(end, F.coalesce("definition", "named")).drop("repo_id", "file", "line", "symbol", "definition", "named")
    return rows.where("src <> dst").select("src", "dst", "kind", "confidence", "flags").distinct()


def call_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller and callee, the names at both ends of Calls edges."""
    names = nodes.select("id", "name")
    calls = edges.where(F.col("kind") == int(EdgeKind.CALLS)).select("src", "dst")
    return calls.join(names.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").select("caller", "callee")


def function_ranges(nodes: DataFrame) -> DataFrame:
    """id, file, line and next_line, where the next symbol of the file begins (null for the last)."""
    symbols = nodes.where((F.col("kind") == int(NodeKind.SYMBOL)) & F.col("file").isNotNull())
    at = symbols.select("file", "line").distinct().withColumn("next_line", F.lead("line").over(Window.partitionBy("file").orderBy("line")))
    return symbols.select("id", "file", "line").join(at, ["file", "line"])
