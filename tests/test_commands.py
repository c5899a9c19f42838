import pytest
from pyspark.sql import functions as F

from latticework.functions import paths, predicates
from latticework.errors import ConfigError, SymbolNotFound
from latticework.operators import matching
from latticework.plans import commands, tools
from latticework.sources import store

CLIENT = """import os
import requests as rq
from gen import orders_pb2_grpc

def fetch():
    base = os.getenv("ORDERS_URL")
    return rq.get("http://orders.shop/v1/items")

def stub():
    return orders_pb2_grpc.OrdersStub(None)

def main():
    fetch()
    stub()
"""
SERVER = """import orders_pb2_grpc as pb

@app.get("/v1/items")
def items():
    return load()

def serve():
    pb.add_OrdersServicer_to_server(None, None)
"""
QUEUES = """
def push():
    kafka_producer.send("orders-topic", 1)
    redis.from_url("redis://cache:6379")

def pull():
    consumer.subscribe("orders-topic")

def chat():
    websocket.connect("ws://gw/ws/chat")
"""
GATEWAY = """
@app.websocket("/ws/chat")
def ws():
    pass
"""
SHARED = "def load():\n    return 1\n"
YAML = 'kind: Deployment\nmetadata:\n  name: web\nspec:\n  containers:\n  - name: c\n    image: gcr.io/p/orders:2\n    env:\n    - name: ORDERS_URL\n      value: "http://orders:80"\n'


@pytest.fixture(scope="module")
def built(spark):
    rows = [("web", "client.py", CLIENT), ("orders", "server.py", SERVER), ("orders", "lib.py", SHARED), ("web", "queues.py", QUEUES), ("gw", "gateway.py", GATEWAY), ("web", "k8s.yaml", YAML), ("orders", "Dockerfile", "FROM gcr.io/p/orders:1\n"), ("orders", "o.proto", "package shop;\nservice Orders {\n rpc List (A) returns (B);\n}\n")]
    return commands.build(spark, spark.createDataFrame(rows, "repo string, file string, content string"))


def test_graph(built):
    names = {r.id: (r.kind, r.name, r.repo) for r in built.nodes.collect()}
    assert {(3, "fetch", "web"), (3, "items", "orders"), (4, "GET /v1/items", "orders"), (7, "ORDERS_URL", "web"), (4, "shop.Orders.List", "orders"), (5, "shop.Orders", "orders")} <= set(names.values())
    assert sorted(names) == list(range(len(names)))
    edges = {(names[r.src][1], names[r.dst][1], r.kind) for r in built.edges.collect()}
    assert {("main", "fetch", 1), ("main", "stub", 1), ("items", "load", 1), ("fetch", "ORDERS_URL", 6), ("fetch", "http://orders.shop/v1/items", 8), ("http://orders.shop/v1/items", "ORDERS_URL", 7)} <= edges
    assert ("stub", "serve", 3) in edges and ("chat", "ws", 3) in edges
    assert {("push", "orders-topic", 9), ("pull", "orders-topic", 10), ("push", "redis://cache:6379", 8), ("chat", "/ws/chat", 8), ("ws", "/ws/chat", 4)} <= edges
    assert {(r.name, r.sub_kind) for r in built.nodes.where("kind = 4 and sub_kind > 0").collect()} == {("orders-topic", 3), ("/ws/chat", 1)}


def test_matches(built):
    got = {(r.type, r.client_file, r.server_file, round(r.confidence, 2)) for r in built.matches.collect()}
    assert got == {("grpc", "client.py", "server.py", 0.95), ("rest", "client.py", "server.py", 0.85), ("k8s", "client.py", "k8s.yaml", 0.95), ("image", "k8s.yaml", "Dockerfile", 0.95), ("websocket", "queues.py", "gateway.py", 0.75)}


def test_report_and_filters(built):
    rows = commands.network(built).collect()
    assert {r.section for r in rows} == {"connects", "exposes", "messages", "calls", "cross_repo"}
    assert any(r.section == "connects" and r.file == "client.py" for r in rows)
    assert {r.direction for r in commands.network(built, direction="inbound").collect()} == {"inbound"}
    assert all("http" in r.kind for r in commands.network(built, kind="http").collect())
    remote = built.calls.withColumns({"file": F.lit("[other] x.py"), "line": F.lit(1)}).limit(1)
    more = commands.network(built, remote=remote, include_all=True).where("file like '[other]%'")
    assert more.count() == 1
    assert {r.section for r in commands.network_json(commands.network(built)).collect()} == {"connects", "exposes", "messages", "calls", "cross_repo"}
    assert commands.network(built, service="fetch").where("section = 'connects'").count() <= 1


def test_trace(built):
    out = commands.trace(built, "fetch")
    (up,) = out["upstream"].collect()
    names = {r.id: r.name for r in built.nodes.collect()}
    assert [names[n] for n in up.nodes] == ["main", "fetch"]
    assert "ORDERS_URL" in {names[r.node] for r in out["downstream"].collect()}
    assert [r.name for r in commands.trace(built, "fetc")["suggestions"].collect()] == ["fetch"]
    ids = built.nodes.where("name = 'ORDERS_URL'").select("id")
    (row,) = commands.variable_summary(built.nodes, built.edges, built.calls, ids).collect()
    assert row.readers == ["fetch"] and row.resolves == ["http://orders.shop/v1/items"]


def test_diff_fix_explain_save(spark, built, tmp_path):
    assert commands.diff(built, built).count() == 0
    summary, template = commands.fix(built)
    assert summary.first().total == built.calls.count() and "[[sinks]]" in template
    assert commands.explain(built, "rq.get").count() == 1
    commands.save(built, f"file://{tmp_path}/t")
    nodes, _ = store.load_graph(spark, f"file://{tmp_path}/t", verify=True)
    assert nodes.count() == built.nodes.count()
    assert matching.call_names(built.edges, built.nodes).where("caller = 'main'").count() == 2
    assert {(r.line, r.next_line) for r in matching.function_ranges(built.nodes).where("file = 'client.py'").collect()} == {(5, 9), (9, 12), (12, None)}


def test_hints_and_aliases(spark):
    df = spark.createDataFrame(
        [(1, '{"Literal":{"value":"http://a"}}'), (2, '{"Dynamic":{"hint":"unresolved var: /ws/s2s)"}}'), (3, '{"EnvVar":{"var_name":"X","k8s_value":null}}'), (4, '{"EnvVar":{"var_name":"X","k8s_value":"svc:1"}}'), (5, "{}")], "k int, s string"
    )
    assert {r.k: r.h for r in df.select("k", paths.address_hint(F.col("s")).alias("h")).collect()} == {1: "http://a", 2: "/ws/s2s", 3: "env:X", 4: "svc:1", 5: ""}
    cases = [("http://h/p/q", "/p/q"), ("http://h/", None), ("/x", "/x"), ("/", None), ("h/x", None)]
    got = spark.createDataFrame([(u,) for u, _ in cases], "u string").select("u", paths.url_path(F.col("u")).alias("p")).collect()
    assert [(r.u, r.p) for r in got] == cases
    aliases = [("go", "a/b/v2", "b"), ("go", "a/b/v10", "v10"), ("java", "a.b.C", "C"), ("python", "a.b", "a.b"), ("typescript", "@x/y", "y"), ("c", "x.h", None)]
    got = spark.createDataFrame([a[:2] for a in aliases], "l string, p string").select(paths.import_alias(F.col("p"), F.col("l")).alias("a")).collect()
    assert [r.a for r in got] == [a[2] for a in aliases]
    values = spark.createDataFrame([("a:1",), ("x.io",), ("plain",), (":80",)], "v string").select(predicates.address_like(F.col("v")).alias("x")).collect()
    assert [r.x for r in values] == [True, True, False, True]


def test_overlay_edges(spark):
    nodes = spark.createDataFrame([(1, 3, "f", "a.go", 3, 0), (2, 3, "g", "b.go", 1, 1), (3, 5, "S", None, 0, 1)], "id bigint, kind int, name string, file string, line int, repo int")
    index = spark.createDataFrame([("c", "K", 0, "r0", "a.go", 9, "x"), ("s", "K", 1, "r1", "b.go", 5, "g"), ("s", "K", 1, "r1", "none.go", 1, "S")], "map_name string, key string, repo_id int, repo_name string, file string, line int, symbol string")
    edges = matching.overlay_edges(matching.overlay(index, "c", "s", 3, 230), nodes)
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (2, 1), (1, 3), (3, 1)}


def test_tools(built):
    assert [r.name for r in tools.call(built, "path", source="main", target="ORDERS_URL").collect()] == ["main", "fetch", "ORDERS_URL"]
    assert [r.name for r in tools.call(built, "path", source="ORDERS_URL", target="fetch", direction="up").collect()] == ["ORDERS_URL", "fetch"]
    assert tools.call(built, "diff", before=built.calls).count() == 0
    assert tools.call(built, "explain", target="client.py").count() == built.calls.where("file = 'client.py'").count()
    with pytest.raises(SymbolNotFound):
        tools.call(built, "path", source="nobody", target="main")
    with pytest.raises(ConfigError):
        tools.call(built, "nothing")
