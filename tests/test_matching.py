from pyspark.sql import functions as F

from latticework.functions import classify
from latticework.model import EdgeKind
from latticework.operators import calls as C
from latticework.operators import matching as M
from latticework.operators import provenance, registry_table, search, sinks
from latticework.sources import store

SITE = "repo string, path string, method string, file string, line int"


def rest(spark, clients, servers):
    c = spark.createDataFrame([(r, p, m, f"c{k}", k) for k, (r, p, m) in enumerate(clients)], SITE)
    s = spark.createDataFrame([(r, p, m, f"s{k}", k) for k, (r, p, m) in enumerate(servers)], SITE)
    return sorted((r.client_file, r.server_file, round(r.confidence, 2), r.method, r.exact) for r in M.match_rest(c, s).collect())


def test_rest(spark):
    assert rest(spark, [("a", "/v1/x/", "get")], [("b", "/V1/x", "GET"), ("a", "/v1/x", ""), ("b", "/v1//x", "POST")]) == [("c0", "s0", 0.85, "GET", True), ("c0", "s1", 0.4, "", True), ("c0", "s2", 0.6, "", True)]
    assert rest(spark, [("a", "/health", "")], [("b", "/health", "")]) == []
    assert rest(spark, [("a", "/v1/items/7", "")], [("b", "/v1/items", ""), ("a", "/v1/items/", ""), ("b", "/v1", "")]) == [("c0", "s0", 0.6, "", False), ("c0", "s1", 0.3, "", False)]
    assert rest(spark, [("a", "/v1/items", "")], [("b", "/v1/items2", "")]) == [("c0", "s0", 0.6, "", False)]
    assert rest(spark, [("a", "/v1/x", "")], [("b", "/v1/x", ""), ("b", "/v1/x/y", "")]) == [("c0", "s0", 0.85, "", True)]


def test_websockets(spark):
    c = spark.createDataFrame([("a", "ws://api.ns.svc.cluster.local:80/ws/s2s", "c0", 1), ("a", "/ws/only/here", "c1", 1), ("a", "wss://h/zzz", "c2", 1)], "repo string, url string, file string, line int")
    s = spark.createDataFrame([("b", "/ws/s2s", "s0", 1), ("a", "/ws/s2s/", "s1", 1), ("b", "/ws", "s2", 1), ("b", "/", "s3", 1)], "repo string, path string, file string, line int")
    got = {(r.client_file, r.server_file): (round(r.confidence, 2), r.exact) for r in M.match_websockets(c, s).collect()}
    assert got == {("c0", "s0"): (0.85, True), ("c0", "s1"): (0.4, True), ("c1", "s2"): (0.5, False), ("c1", "s3"): (0.5, False), ("c2", "s3"): (0.5, False)}


def test_resolver_chain(spark):
    stubs = spark.createDataFrame([("native", "TranslationStreaming", "a.go", 1), ("native", "Other", "a.go", 2)], "repo string, service_name string, file string, line int")
    regs = spark.createDataFrame([("gateway", "TranslationStreaming", "b.go", 3)], stubs.schema)
    protos = spark.createDataFrame([("TranslationStreaming",)], "service_name string")
    grpc = M.match_protos(stubs, regs, protos)
    assert [(round(r.confidence, 2), r.known) for r in grpc.collect()] == [(0.95, True)]
    assert [r.service_name for r in M.unresolved_stubs(stubs, regs).collect()] == ["Other"]
    reads = spark.createDataFrame([("gateway", "BACKEND_SERVICE_URL", "c.py", 4)], "repo string, var_name string, file string, line int")
    defs = spark.createDataFrame([("ops", "BACKEND_SERVICE_URL", "http://backend.ns.svc.cluster.local:80", "v.yaml", 5), ("ops", "BACKEND_SERVICE_URL", "plain", "v.yaml", 6)], "repo string, var_name string, value string, file string, line int")
    helm = M.match_helm_env(reads, defs)
    assert sorted(round(r.confidence, 2) for r in helm.collect()) == [0.7, 0.85]
    bound = M.match_env_services(reads, defs.withColumn("deployment_name", F.lit("frontend")))
    assert sorted((r.to.service, round(r.confidence, 2)) for r in bound.collect()) == [("backend", 0.95), ("plain", 0.8)]
    built = spark.createDataFrame([("app", "gcr.io/p/app:1", "Dockerfile"), ("app", "other/tts", "Dockerfile")], "repo string, image_ref string, file string")
    used = spark.createDataFrame([("ops", "gcr.io/p/app:2", "k.yaml", 1), ("ops", "x/tts@sha256:1", "k.yaml", 2)], "repo string, image_ref string, file string, line int")
    images = M.match_images(built, used)
    assert sorted((r.used_line, round(r.confidence, 2)) for r in images.collect()) == [(1, 0.95), (2, 0.7)]
    counts = {r.type: r.n for r in M.resolution_counts(M.resolution(grpc=grpc, helm=helm.drop("k8s"), image=images)).collect()}
    assert counts == {"grpc": 1, "helm": 2, "image": 2, "total": 5}


def test_enclosing_takes_the_last_and_the_first_of_equals(spark):
    defs = spark.createDataFrame([("f", 1, 10), ("f", 5, 12), ("f", 5, 11), ("g", 1, 20)], "file string, line int, id bigint")
    sites = spark.createDataFrame([("f", 0), ("f", 1), ("f", 5), ("f", 9), ("h", 3)], "file string, line int")
    assert {(r.file, r.line): r.definition for r in M.enclosing(sites, defs).collect()} == {("f", 0): None, ("f", 1): 10, ("f", 5): 11, ("f", 9): 11, ("h", 3): None}


def test_match_edges_and_calls(spark):
    defs = spark.createDataFrame([("a", "f", 1, 1), ("b", "g", 1, 2)], "repo string, file string, line int, id bigint")
    matches = spark.createDataFrame([("a", "f", 5, "b", "g", 7, 0.95), ("a", "f", 5, "a", "f", 6, 0.5), ("a", "x", 1, "b", "g", 7, 0.95)], "client_repo string, client_file string, client_line int, server_repo string, server_file string, server_line int, confidence double")
    assert [(r.src, r.dst, r.kind, r.confidence, r.flags) for r in M.match_edges(matches, defs).collect()] == [(1, 2, 3, 242, 1)]
    nodes = spark.createDataFrame([(1, 3, "f"), (2, 3, "f"), (3, 4, "f")], "id bigint, kind int, name string")
    calls = spark.createDataFrame([(9, "f"), (1, "f"), (9, "nobody")], "caller bigint, name string")
    assert {(r.src, r.dst) for r in M.resolve_calls(calls, nodes).collect()} == {(9, 1)}
    same = M.same_name_edges(spark.createDataFrame([(1, 4, "/x", 0), (2, 4, "/x", 1), (3, 4, "/health", 0), (4, 4, "/health", 1)], "id bigint, kind int, name string, repo int"), 4, EdgeKind.CONNECTS, skip=M.GENERIC_ENDPOINTS)
    assert {(r.src, r.dst) for r in same.collect()} == {(1, 2), (2, 1)}


CALLS = "file string, line int, net_kind string, callee_fqn string, address_source string, confidence string, repo string, seq bigint"


def test_diff_properties(spark):
    a = spark.createDataFrame([("f", 1, "http_client", "x", "s", "heuristic", None, 1), ("f", 2, "redis", "y", "s", "heuristic", None, 2), ("f", 2, "redis", "y", "t", "heuristic", None, 3)], CALLS)
    b = spark.createDataFrame([("f", 2, "database", "y", "t", "heuristic", None, 1), ("g", 1, "redis", "z", None, "heuristic", None, 2)], CALLS)
    shown = lambda x, y: sorted((r.key, r.change) for r in C.diff(x, y).collect())
    assert shown(a, a) == []
    assert shown(a, b) == [("f:1:x", "removed"), ("f:2:y", "changed"), ("g:1:z", "added")]
    swap = {"added": "removed", "removed": "added", "changed": "changed"}
    assert shown(b, a) == sorted((k, swap[c]) for k, c in shown(a, b))
    assert C.dedup(C.dedup(a)).count() == C.dedup(a).count() == 2


def test_outbound_ways(spark):
    out = spark.createDataFrame([("o.go", 1, "c", "http://h/v1/items/7", "a"), ("o.go", 2, "pb.NewBillingClient", "", "a"), ("o.go", 3, "c", "http://billing.ns.svc.cluster.local:80/", "a"), ("o.go", 4, "c", "grpc:Foo", "a"), ("x/tests/o.go", 5, "c", "http://h/v1/items", "a"), ("o.go", 6, "c", "http://h/v1/items", "b")], "file string, line int, callee string, address_hint string, repo string")
    ends = spark.createDataFrame([("e.go", 1, "/v1/items", "main", "b"), ("e.go", 2, "/zz/top", "RegisterBillingServer", "b"), ("e.go", 3, "/yy/y", "billing", "b"), ("e.go", 4, "grpc:foo", "main", None), ("e.go", 5, "/", "billing", "b")], "file string, line int, path string, service string, repo string")
    assert sorted((r.line, r.e_line, r.match_type) for r in C.outbound_matches(out, ends).collect()) == [(1, 1, "path"), (2, 2, "grpc"), (3, 2, "url"), (3, 3, "url"), (4, 4, "grpc")]


def test_trigrams(spark):
    names = spark.createDataFrame([(1, "handleAudioStream"), (2, "handleVideoStream"), (3, "processAudio"), (4, "StreamingRecognize"), (5, "Größe")], "id bigint, name string")
    assert [r.name for r in search.trigram_search(names, "handleAudio").collect()] == ["handleAudioStream", "handleVideoStream", "processAudio"]
    assert search.trigram_search(names, "streamingrecognize").first().name == "StreamingRecognize"
    assert search.trigram_search(names, "qqqqqq").count() == 0
    assert [r.id for r in search.trigram_search(names, "öß").collect()] == [5]
    assert [r.id for r in search.trigram_search(names, "ße").collect()] == [5]
    index = search.trigram_index(names)
    assert [tuple(r) for r in search.trigram_search(names, "handleAudio", index=index).collect()] == [tuple(r) for r in search.trigram_search(names, "handleAudio").collect()]


def test_targets(spark):
    nodes = spark.createDataFrame([(1, 3, "f", "a.py", 1), (2, 3, "g", "a.py", 10), (3, 7, "DB_URL", None, 0), (4, 7, "DB_HOST", None, 0)], "id bigint, kind int, name string, file string, line int")
    found = lambda t, calls=None: {(r.id, r.how) for r in search.resolve_target(nodes, t, calls).collect()}
    assert found("env:DB_*") == {(3, "env"), (4, "env")}
    assert found("a.py:12") == {(2, "line")}
    assert found("call:a.py:f") == {(1, "call")}
    assert found("g") == {(2, "name")}
    calls = spark.createDataFrame([("a.py", 3, "http_client", "requests.get", '{"Literal":{"value":"http://z"}}', "heuristic", None, 1)], CALLS)
    assert found("requests.get", calls) == {(1, "callee")} and found("http://z", calls) == {(1, "address")} and found("nothing", calls) == set()


def test_provenance(spark):
    tree = '{"Concat":{"parts":[{"Literal":{"value":"http://"}},{"Parameter":{"func":"f","idx":0,"caller_sources":[{"EnvVar":{"var_name":"HOST","k8s_value":null}}]}}]}}'
    df = spark.createDataFrame([(1, tree), (2, "no json"), (3, None), (4, '{"Dynamic":{"hint":""}}')], "k int, t string")
    flat = provenance.flattened("t")
    rows = {r.k: r for r in df.select("k", flat.alias("flat"), provenance.formatted("t").alias("line")).collect()}
    assert [(n.depth, n.kind) for n in rows[1].flat] == [(0, "Concat"), (1, "Literal"), (1, "Parameter"), (2, "EnvVar")]
    assert "HOST" in rows[1].line and rows[2].line is None and rows[3].flat == []
    told = df.select("k", flat.alias("flat")).select("k", provenance.first_variable(F.col("flat")).alias("v"), provenance.mentions(F.col("flat"), "http").alias("m")).collect()
    assert {r.k: (r.v, r.m) for r in told} == {1: ("HOST", True), 2: (None, False), 3: (None, False), 4: (None, False)}
    uses = spark.createDataFrame([(1, "f", 10, "c"), (2, "f", 2, "zz"), (3, "f", 30, "loop")], "use bigint, file string, at int, name string")
    made = spark.createDataFrame([("f", 1, "a", "env", "URL"), ("f", 3, "b", "variable", "a"), ("f", 5, "c", "variable", "b"), ("f", 12, "c", "literal", "late"), ("f", 20, "loop", "variable", "loop")], "file string, at int, name string, kind string, value string")
    assert {(r.use, r.depth, r.kind, r.value) for r in provenance.trace_back(uses, made).collect()} == {(1, 2, "env", "URL"), (2, 0, "unknown", "zz"), (3, 1, "unknown", "loop")}
    assert {(r.use, r.kind, r.value) for r in provenance.trace_back(uses.where("use = 1"), made, 1).collect()} == {(1, "dynamic", "depth-exceeded")}


def test_rules_come_in_order(spark):
    calls = spark.createDataFrame([(1, "f", "rq", "get", "http://x"), (2, "f", "mylib", "send", ""), (3, "f", "axios", "post", ""), (4, "f", "thing", "foo", "h:80"), (5, "f", "thing", "foo", "x")], "id bigint, file string, receiver string, callee string, first_arg string")
    imports = spark.createDataFrame([("f", "requests", "rq"), ("f", "corp/mylib", "mylib")], "file string, path string, alias string")
    rules = store.custom_rules(spark, '[[sinks]]\nfqn = "mylib.send"\ncategory = "kafka_producer"\n[[sinks]]\nfqn = "x"\ncategory = "nonsense"\n')
    got = {r.id: (r.category, r.how) for r in sinks.told(calls, imports, sinks.builtin(spark), rules).collect()}
    assert got == {1: ("http_client", "registry"), 2: ("kafka_producer", "custom"), 3: ("http_client", "registry"), 4: ("unknown", "permissive")}


def test_prefix_matches_do_not_meet_on_shared_beginnings(spark):
    servers = spark.range(50_000).selectExpr("'r2' as repo", "concat('/api/v1/', id) as path", "'get' as method", "'s' as file", "cast(id as int) as line")
    calls = spark.createDataFrame([("r1", "/api/v1/77/more", "get", "c", 1), ("r1", "/api/v1", "get", "c", 2), ("r1", "/api/other/x", "get", "c", 3)], "repo string, path string, method string, file string, line int")
    found = M.rest_prefix(calls, servers)
    by = found.groupBy("client_line").count().collect()
    assert {r.client_line: r["count"] for r in by} == {1: 2, 2: 50_000}  # /api/v1/7 and /api/v1/77
    sockets = servers.selectExpr("repo", "path", "file", "line")
    near = M.match_websockets(calls.selectExpr("repo", "path as url", "file", "line"), sockets).where("not exact")
    assert {r.client_line: r["count"] for r in near.groupBy("client_line").count().collect()} == {1: 2, 2: 50_000}
    joins = [x for x in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "Join" in x]
    assert joins and not any("Cartesian" in x or "NestedLoop" in x or "block" in x for x in joins)


def test_the_registry_is_whole():
    rows = registry_table.sink_rows(classify.INBOUND_KINDS)
    assert len(rows) == len({r[1] for r in rows}) == 375 and len(set(registry_table.route_rows())) == 75
    by = {r[1]: r for r in rows}
    assert by["net/http.NewRequestWithContext"][2:] == ("http_client", 2, "outbound") and by["grpc::CreateChannel"][0] == "cpp" and by["fetch"][3] == 0
    assert by["boto3.client.SQS.receive_message"][4] == "inbound" and by["sendto"][3] == 4
