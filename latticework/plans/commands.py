"""What a user asks for: building a graph from source trees, tracing, reporting, comparing, fixing and explaining."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import classify, paths, predicates
from latticework.model import SUB_QUEUE, SUB_WEBSOCKET, EdgeKind, NodeKind
from latticework.operators import calls as C
from latticework.operators import graph, matching, provenance, search, sinks, traverse
from latticework.sources import code, files, infra, store
from latticework.storage import stored


@dataclass(frozen=True)
class Topology:
    """A built graph: nodes, edges, network calls, and the matches across repositories."""

    nodes: DataFrame
    edges: DataFrame
    calls: DataFrame
    matches: DataFrame


_KEY = ["kind", "name", "file", "line", "repo"]


def _nodes(df: DataFrame, kind: NodeKind, name, sub_kind: int = 0) -> DataFrame:
    return df.select(F.lit(int(kind)).alias("kind"), F.lit(sub_kind).alias("sub_kind"), F.expr(name) if isinstance(name, str) else name.alias("name"), "file", F.col("line").cast("int").alias("line"), "repo")


def build(spark: SparkSession, trees: DataFrame, registry: DataFrame | None = None, rules: DataFrame | None = None) -> Topology:
    """From files (repo, file, content) of any number of repositories. Every step is a join or a filter of the table of facts."""
    routed = stored(files.routed(trees), "files")
    raw_facts = stored(code.facts(routed.where("route = 'code' and not is_generated").select("repo", "file", "language", "content")), "raw-facts")
    found = stored(code.propagated(raw_facts), "facts")
    manifests, yaml = routed.where("route = 'proto'"), routed.where("route = 'infra' and not file rlike '(^|/)Dockerfile'")
    routes, http, reads, grpc, rpcs = code.http_routes(found), code.http_calls(found), code.env_reads(found), code.grpc_sites(found), infra.protos(manifests)

    test_flag = F.when(predicates.test_path(F.col("file")), 16).otherwise(0)
    links = code.connections(found)
    sockets, queues, resources = links.where("kind like 'websocket%'"), links.where("kind like 'kafka%'"), links.where("kind in ('database', 'redis', 'sqs', 's3')")
    parts = [
        _nodes(found.where("fact in ('function', 'method', 'type')"), NodeKind.SYMBOL, F.col("name")),
        _nodes(routes, NodeKind.ENDPOINT, F.trim(F.concat_ws(" ", "method", "path"))),
        _nodes(http, NodeKind.ENDPOINT, F.col("url")),
        _nodes(reads, NodeKind.RESOURCE, F.col("var_name")),
        _nodes(rpcs, NodeKind.ENDPOINT, F.col("name")),
        _nodes(sockets, NodeKind.ENDPOINT, F.col("name"), SUB_WEBSOCKET),
        _nodes(queues, NodeKind.ENDPOINT, F.col("name"), SUB_QUEUE),
        _nodes(resources, NodeKind.RESOURCE, F.col("name")),
        _nodes(infra.proto_services(manifests).withColumn("line", F.lit(1)), NodeKind.SURFACE, F.col("fqn")),
    ]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    keyed = raw.groupBy("kind", "name", "file", "repo").agg(F.min("line").alias("line"), F.max("sub_kind").alias("sub_kind"))
    symbols = parts[0].groupBy(*_KEY).agg(F.first("sub_kind").alias("sub_kind"))
    ids = stored(symbols.unionByName(keyed.where(F.col("kind") != int(NodeKind.SYMBOL)).select(*symbols.columns)).withColumn("id", F.xxhash64(*_KEY)), "node-keys")
    numbers = graph.numbered(ids)
    nodes = ids.join(numbers, "id").select(F.col("number").alias("id"), "kind", "sub_kind", test_flag.alias("flags"), "name", "file", "line", F.lit(None).cast("bigint").alias("parent"), "repo")
    nodes = stored(nodes, "nodes")

    symbol = nodes.where(F.col("kind") == int(NodeKind.SYMBOL)).select("repo", "file", "line", "id")

    def from_owner(df: DataFrame, name, kind: NodeKind, edge: EdgeKind) -> DataFrame:
        named = nodes.where(F.col("kind") == int(kind)).select("repo", "file", F.col("name").alias("_name"), F.col("id").alias("dst"))
        at = matching.enclosing(df.select("repo", "file", F.col("line").cast("int").alias("line"), name.alias("_name")), symbol, ("repo", "file"))
        return at.where("definition is not null").join(named, ["repo", "file", "_name"]).select(F.col("definition").alias("src"), "dst", F.lit(int(edge)).alias("kind"))

    by_name = symbol.join(nodes.select("id", "name"), "id").groupBy("repo", "file", "name").agg(F.min("id").alias("sym"))
    done, left = code.same_file_calls(found)
    callers = by_name.select("repo", "file", F.col("name").alias("caller"), F.col("sym").alias("src"))
    same = done.join(callers, ["repo", "file", "caller"]).join(by_name.select("repo", "file", F.col("name").alias("callee"), F.col("sym").alias("dst")), ["repo", "file", "callee"]).select("src", "dst", F.lit(int(EdgeKind.CALLS)).alias("kind"))
    far = matching.resolve_calls(left.join(callers, ["repo", "file", "caller"]).select(F.col("src").alias("caller"), "name"), nodes).withColumn("kind", F.lit(int(EdgeKind.CALLS)))
    edges = (
        same.unionByName(far)
        .unionByName(from_owner(routes.withColumn("line", F.col("site")), F.trim(F.concat_ws(" ", "method", "path")), NodeKind.ENDPOINT, EdgeKind.EXPOSES))
        .unionByName(from_owner(http, F.col("url"), NodeKind.ENDPOINT, EdgeKind.CONNECTS))
        .unionByName(from_owner(reads, F.col("var_name"), NodeKind.RESOURCE, EdgeKind.CONFIGURES))
        .unionByName(from_owner(sockets.where("kind = 'websocket_server'"), F.col("name"), NodeKind.ENDPOINT, EdgeKind.EXPOSES))
        .unionByName(from_owner(sockets.where("kind = 'websocket_client'"), F.col("name"), NodeKind.ENDPOINT, EdgeKind.CONNECTS))
        .unionByName(from_owner(queues.where("kind = 'kafka_producer'"), F.col("name"), NodeKind.ENDPOINT, EdgeKind.PUBLISHES))
        .unionByName(from_owner(queues.where("kind = 'kafka_consumer'"), F.col("name"), NodeKind.ENDPOINT, EdgeKind.SUBSCRIBES))
        .unionByName(from_owner(resources, F.col("name"), NodeKind.RESOURCE, EdgeKind.CONNECTS))
        .withColumns({"confidence": F.lit(255), "flags": F.lit(0)})
    )

    clients, servers = (grpc.where(F.col("side") == s).drop("side") for s in ("client", "server"))
    bindings = infra.env_bindings(yaml)
    matches = matching.resolution(
        grpc=_sites(matching.match_protos(clients, servers, infra.proto_services(manifests).select("service_name"))),
        websocket=_sites(matching.match_websockets(sockets.where("kind = 'websocket_client'").select("repo", F.col("name").alias("url"), "file", "line"), sockets.where("kind = 'websocket_server'").select("repo", F.col("name").alias("path"), "file", "line"))),
        rest=_sites(matching.match_rest(http.select("repo", "path", "method", "file", "line"), routes.select("repo", "path", "method", "file", "line"))),
        k8s=_bound(matching.match_env_services(reads.select("repo", "var_name", "file", "line"), bindings.select("var_name", "value", "file", "line", "deployment_name"))),
        image=_used(matching.match_images(infra.dockerfiles(routed.where("route = 'infra' and file rlike '(^|/)Dockerfile'")).select("repo", "image_ref", "file"), infra.container_images(yaml))),
    )
    matches = stored(matches, "matches")
    crossing = matching.match_edges(matches.where("client_repo <> server_repo"), symbol)
    variables = nodes.where((F.col("kind") == int(NodeKind.RESOURCE)) & predicates.address_variable(F.col("name"))).select(F.col("id").alias("node"))
    base = stored(graph.dedup_edges(edges.unionByName(crossing)), "edges")
    resolved = traverse.resolves_same_function(base, variables).union(traverse.resolves_backward(base, variables)).union(traverse.resolves_forward(base, variables)).distinct()
    resolved = resolved.withColumns({"kind": F.lit(int(EdgeKind.RESOLVES)), "confidence": F.lit(200), "flags": F.lit(0)})
    return Topology(nodes, stored(graph.dedup_edges(base.unionByName(resolved)), "all-edges"), stored(network_calls(spark, found, yaml, registry, rules), "calls"), matches)


def _sites(df: DataFrame) -> DataFrame:
    return df.select(*(f"{s}_{c}" for s in ("client", "server") for c in ("repo", "file", "line")), F.col("confidence").cast("double").alias("confidence"))


def _bound(df: DataFrame) -> DataFrame:
    return df.select(F.col("read_repo").alias("client_repo"), F.col("read_file").alias("client_file"), F.col("read_line").alias("client_line"), F.lit(None).cast("string").alias("server_repo"), F.col("bound_file").alias("server_file"), F.col("bound_line").alias("server_line"), F.col("confidence").cast("double").alias("confidence"))


def _used(df: DataFrame) -> DataFrame:
    return df.select(F.col("used_repo").alias("client_repo"), F.col("used_file").alias("client_file"), F.col("used_line").alias("client_line"), F.col("built_repo").alias("server_repo"), F.col("built_file").alias("server_file"), F.lit(1).alias("server_line"), F.col("confidence").cast("double").alias("confidence"))


def network_calls(spark: SparkSession, found: DataFrame, yaml: DataFrame, registry: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Network calls of code, told by rules and traced to their sources in the file, and those that manifests' variables stand for."""
    calls = found.where("fact = 'call'").withColumn("id", F.xxhash64("repo", "file", "line", "receiver", "name"))
    rows = calls.select("id", "repo", "file", "line", "receiver", F.col("name").alias("callee"), F.coalesce("value", F.lit("")).alias("first_arg"), "arg_name")
    imports = found.where("fact = 'import'").select("file", F.col("value").alias("path"), F.coalesce("name", paths.import_alias(F.col("value"), F.col("language"))).alias("alias"))
    told = sinks.told(rows, imports, registry if registry is not None else sinks.builtin(spark), rules if rules is not None else store.custom_rules(spark, ""))
    told = stored(told, "told")
    traced = traced_sources(told, code.assignments(found))
    literal = F.to_json(F.struct(F.struct(F.col("first_arg").alias("value")).alias("Literal")))
    told = told.join(traced.select(F.col("id").alias("traced_id"), "traced"), F.col("id") == F.col("traced_id"), "left")
    source = F.when(F.col("first_arg") != "", literal).otherwise(F.coalesce("traced", F.lit('{"Dynamic":{"hint":""}}')))
    fqn = F.concat_ws(".", "receiver", "callee")
    direct = told.select("file", "line", F.col("category").alias("net_kind"), fqn.alias("callee_fqn"), source.alias("address_source"), "confidence", "repo", F.col("id").alias("seq"))
    hidden = infra.network_variables(yaml).select("file", "line", "net_kind", "callee_fqn", "address_source", F.lit("heuristic").alias("confidence"), "repo", F.xxhash64("repo", "file", "line").alias("seq"))
    return C.first_wins(direct, hidden)


def traced_sources(calls: DataFrame, assignments: DataFrame) -> DataFrame:
    """id and traced, the JSON source of calls (id, repo, file, line, first_arg, arg_name) whose address is a name: where its value was last assigned in the file."""
    place = F.concat_ws(":", "repo", "file")
    uses = calls.where("first_arg = '' and arg_name is not null").select(F.col("id").alias("use"), place.alias("file"), F.col("line").alias("at"), F.col("arg_name").alias("name")).distinct()
    ends = provenance.trace_back(uses, assignments.withColumn("file", place))
    one = ends.groupBy("use").agg(F.max_by(F.struct("kind", "value"), F.struct("depth", "kind", "value")).alias("end")).select("use", "end.kind", "end.value")
    literal = F.struct(F.struct(F.col("value").alias("value")).alias("Literal"))
    variable = F.struct(F.struct(F.col("value").alias("var_name"), F.lit(None).cast("string").alias("k8s_value")).alias("EnvVar"))
    owner, index = F.substring_index("value", ":", 1), F.substring_index("value", ":", -1).cast("int")
    parameter = F.struct(F.struct(owner.alias("func"), index.alias("param_idx"), F.array().cast("array<string>").alias("caller_sources")).alias("Parameter"))
    hint = F.struct(F.struct(F.concat_ws(":", "kind", "value").alias("hint")).alias("Dynamic"))
    keep = {"ignoreNullFields": "false"}
    source = F.when(F.col("kind") == "literal", F.to_json(literal)).when(F.col("kind") == "env", F.to_json(variable, keep)).when(F.col("kind") == "parameter", F.to_json(parameter)).otherwise(F.to_json(hint))
    return one.where("kind <> 'unknown'").select(F.col("use").alias("id"), source.alias("traced"))


def trace(topology: Topology, target: str, max_depth: int = 20) -> dict[str, DataFrame]:
    """upstream and downstream paths of the node that a target names, or of each of several a summary; provenance or suggestions for none."""
    nodes, edges = topology.nodes, topology.edges
    found = search.resolve_target(nodes, target, topology.calls)
    ids = [r.id for r in found.select("id").distinct().orderBy("id").limit(2).collect()]
    if not ids:
        return {"provenance": mentions(topology.calls, target), "suggestions": search.suggestions(nodes, target)}
    if len(ids) > 1:
        return {"summary": variable_summary(nodes, edges, topology.calls, found.select("id"))}
    down = traverse.terminals(edges, ids[0], max_depth=max_depth).where(F.size("path") > 0)
    return {"upstream": traverse.upstream_paths(nodes, edges, ids[0], max_depth), "downstream": down.select("node", "depth", F.transform("path", lambda s: s["node"]).alias("nodes")), "provenance": mentions(topology.calls, target)}


def mentions(calls: DataFrame, target: str) -> DataFrame:
    """file, line, net_kind, callee_fqn and chain of calls whose source mentions the target."""
    rows = calls.withColumn("flat", provenance.flattened("address_source")).where(provenance.mentions(F.col("flat"), target))
    return rows.select("file", "line", "net_kind", "callee_fqn", provenance.traced("address_source").alias("chain"))


def variable_summary(nodes: DataFrame, edges: DataFrame, calls: DataFrame, ids: DataFrame, most: int = 3) -> DataFrame:
    """id, name, file, line, readers, resolves (both ways) and up to most chains of each node."""
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    reads = edges.where(F.col("kind") == int(EdgeKind.CONFIGURES)).select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("r").alias("how"))
    both = edges.where(F.col("kind") == int(EdgeKind.RESOLVES))
    solves = both.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("s").alias("how")).union(both.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("s")))
    near = reads.union(solves).join(ids.distinct(), "id", "left_semi").join(names, "other")
    listed = near.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("how") == "r", F.col("other_name")))).alias("readers"), F.array_sort(F.collect_set(F.when(F.col("how") == "s", F.col("other_name")))).alias("resolves"))
    told = calls.select(F.explode(provenance.flattened("address_source")).alias("n"), provenance.formatted("address_source").alias("chain"))
    chains = told.where("n.kind = 'EnvVar'").groupBy(F.substring_index("n.text", " ", 1).alias("name")).agg(F.slice(F.array_sort(F.collect_set("chain")), 1, most).alias("chains"))
    none = F.array().cast("array<string>")
    rows = nodes.join(ids.distinct(), "id", "left_semi").select("id", "name", "file", "line").join(listed, "id", "left").join(chains, "name", "left")
    return rows.select("id", "name", "file", "line", *(F.coalesce(c, none).alias(c) for c in ("readers", "resolves", "chains")))


def network(topology: Topology, remote: DataFrame | None = None, kind: str | None = None, direction: str | None = None, service: str | None = None, include_all: bool = False) -> DataFrame:
    """The report: section, file, line, kind, direction, name, confidence. Sections are connects, exposes, messages, calls and cross_repo."""
    nodes, edges = topology.nodes, topology.edges
    calls = topology.calls
    if remote is not None:
        marked = [df.withColumn("env_var", provenance.first_variable(provenance.flattened("address_source"))) for df in (remote, calls)]
        calls = calls.unionByName(C.remote_kept(*marked, include_all).drop("env_var"))
    calls = stored(C.dedup(C.without_noise(calls)), "report-calls")
    at = nodes.select("id", "name", "file", "line")
    connects = C.connects_report(edges.where(F.col("kind") == int(EdgeKind.CONNECTS)), at, calls)
    rows = connects.select(F.lit("connects").alias("section"), "file", "line", "kind", "direction", F.col("target").alias("name"), "confidence", "symbol")

    def of_edges(kinds: list[EdgeKind], section: str, kind_of) -> DataFrame:
        met = edges.where(F.col("kind").isin([int(k) for k in kinds])).select("src", "dst", F.col("kind").alias("edge")).join(at.select(F.col("id").alias("src"), F.col("name").alias("symbol"), "file", "line"), "src").join(at.select(F.col("id").alias("dst"), "name"), "dst")
        k = kind_of(met)
        return met.select(F.lit(section).alias("section"), "file", "line", k.alias("kind"), F.when(F.col("edge").isin(int(EdgeKind.EXPOSES), int(EdgeKind.SUBSCRIBES)), "inbound").otherwise("outbound").alias("direction"), "name", F.lit("graph").alias("confidence"), "symbol")

    rows = rows.unionByName(of_edges([EdgeKind.EXPOSES], "exposes", lambda m: classify.endpoint_kind(F.col("name"))))
    rows = rows.unionByName(of_edges([EdgeKind.PUBLISHES, EdgeKind.SUBSCRIBES], "messages", lambda m: F.when(F.col("edge") == int(EdgeKind.PUBLISHES), "kafka_producer").otherwise("kafka_consumer")))
    if service is not None:
        up = graph.ancestors(nodes, 10)
        kept = C.service_members(nodes, up, service).join(at.select("id", F.col("file").alias("m_file"), F.col("line").alias("m_line")), "id").select("m_file", "m_line").distinct()
        rows = rows.join(kept, (F.col("file") == F.col("m_file")) & (F.col("line") == F.col("m_line")), "left_semi")
    only = C.taint_only(calls, connects).select(F.lit("calls").alias("section"), "file", "line", F.col("net_kind").alias("kind"), classify.direction(F.col("net_kind")).alias("direction"), F.col("callee_fqn").alias("name"), "confidence", F.lit(None).cast("string").alias("symbol"))
    crossing = topology.matches.where("client_repo <> server_repo").select(F.lit("cross_repo").alias("section"), F.col("client_file").alias("file"), F.col("client_line").alias("line"), F.col("type").alias("kind"), F.lit("outbound").alias("direction"), F.concat_ws(":", "server_file", F.col("server_line").cast("string")).alias("name"), F.lit("resolved").alias("confidence"), F.lit(None).cast("string").alias("symbol"))
    out = rows.unionByName(only).unionByName(crossing)
    if kind is not None:
        out = out.where(classify.kind_matches(F.col("kind"), kind))
    if direction is not None:
        out = out.where((F.col("direction") == direction) & (F.col("section") != ("calls" if direction == "inbound" else "exposes")))
    return out


def network_json(report: DataFrame) -> DataFrame:
    """section and report, a JSON array of its rows in order."""
    row = F.struct("file", "line", "kind", "direction", "name", "confidence", "symbol")
    return report.groupBy("section").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("report"))


def diff(before: Topology | DataFrame, after: Topology | DataFrame) -> DataFrame:
    a, b = (x.calls if isinstance(x, Topology) else x for x in (before, after))
    return C.diff(a, b)


def fix(topology: Topology) -> tuple[DataFrame, str]:
    """How many calls are resolved, and a rule file to fill in for the others."""
    return C.fix_summary(topology.calls), store.rule_template(C.callee_templates(topology.calls))


def explain(topology: Topology, target: str) -> DataFrame:
    return C.explain(topology.calls.withColumn("chain", F.coalesce(provenance.formatted("address_source"), F.lit(""))), target, F.col("chain"))


def save(topology: Topology, path: str) -> None:
    """The graph, the calls and what other repositories can meet; a baseline to compare with is one saved earlier, under a branch's name for example."""
    store.write_graph(topology.nodes, topology.edges, path)
    store.write_network(topology.calls, f"{path}/network")
    repos = topology.nodes.select("repo").distinct().withColumn("repo_id", F.col("repo"))
    store.write_index(store.index_facts(topology.nodes, repos.select("repo_id", F.col("repo").cast("string").alias("repo_name"))), f"{path}/index")


def load(spark: SparkSession, path: str) -> Topology:
    """What save() kept, without the matches: a snapshot to compare with or to ask."""
    nodes, edges = store.load_graph(spark, path)
    none = spark.createDataFrame([], "client_repo string, client_file string, client_line int, server_repo string, server_file string, server_line int, confidence double, type string")
    return Topology(nodes, edges, store.load_network(spark, f"{path}/network"), none)


def pull(spark: SparkSession, sources: dict[str, str], folder: str) -> DataFrame:
    """Takes the calls of remotes (name: path of a saved network) into the folder, and returns the calls of all remotes there."""
    for name, path in sorted(sources.items()):
        store.add_remote(spark, store.load_network(spark, path), name, folder)
    return store.load_remote_networks(spark, folder)
