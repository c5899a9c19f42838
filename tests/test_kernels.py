import pytest
from pyspark.sql import functions as F

from latticework.functions import classify, paths, predicates


def one(spark, value, kernel):
    return spark.createDataFrame([(value,)], "v string").select(kernel(F.col("v"))).first()[0]


def many(spark, kernel, cases):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v string")
    got = {r.k: r.x for r in df.select("k", kernel(F.col("v")).alias("x")).collect()}
    for k, (value, want) in enumerate(cases):
        x = got[k]
        assert (tuple(x) if hasattr(x, "__fields__") else x) == want, value


def test_rest_paths(spark):
    many(spark, paths.rest_path, [(" /API/v1/ ", "/api/v1"), ("", "/"), ("//", "/"), ("/a//b", "/a/b"), ("/a///b", "/a//b"), ("x", "x")])
    many(spark, paths.segments, [("/a/b", 2), ("/", 0), ("a//b/", 2)])


def test_cluster_addresses(spark):
    cases = [
        ("http://orders-staging.shop.svc.cluster.local:8080/v1", ("orders", "shop", "orders-staging.shop.svc.cluster.local", 8080, "/v1")),
        ("orders.shop.svc", ("orders", "shop", "orders.shop.svc", None, "/")),
        ("orders.shop.svc.cluster.local:99999", ("orders", "shop", "orders.shop.svc.cluster.local:99999", None, "/")),
        ("https://api.example.com/x", None),
        ("svc.a.b", None),
        ("a.svc", None),
        ("", None),
    ]
    many(spark, paths.k8s_dns, cases)


def test_service_values(spark):
    cases = [
        ("productcatalogservice:3550", ("productcatalogservice", 3550)),
        ("service.namespace.svc.cluster.local:8080", ("service", 8080)),
        ("bare", ("bare", None)),
        ("grpc://name:1/x", ("name", 1)),
        ('"quoted:80"', ("quoted", 80)),
        ("", None),
        ("{{ .Values.x }}", None),
        ("8080", None),
        ("two words", None),
        ("name:70000", ("name", None)),
    ]
    many(spark, paths.service_value, cases)


def test_images(spark):
    cases = [("gcr.io/p/app:v1", "gcr.io/p/app"), ("app@sha256:ab", "app"), ("host:5000/app", "host:5000/app"), ("host:5000/app:2", "host:5000/app"), ("app", "app"), ("app:1@sha256:x", "app:1")]
    many(spark, paths.image_path, cases)
    many(spark, paths.image_name, [("host:5000/a/app:2", "app"), ("app", "app")])


def test_websocket_paths(spark):
    many(spark, paths.ws_path, [("ws://host:80/ws/s2s", "/ws/s2s"), ("/a", "/a"), ("wss://host", "/"), ("host/x", "/x")])
    many(spark, paths.ws_norm, [("/WS/", "/ws"), ("/", "/"), ("//a//", "//a")])


def test_names(spark):
    many(spark, predicates.env_name_strict, [("A_1", True), ("a", False), ("", False)])
    many(spark, predicates.env_name_loose, [("DB_Url", True), ("DB_Host", False), ("A", False), ("ABcd", False), ("123", False), ("AB c", False)])
    many(spark, predicates.address_variable, [("my_url", True), ("PG_DSN", True), ("DSN_X", False)])
    many(spark, predicates.network_value, [("http://x", True), ("redis:6379", True), ("kafka:9092/t", True), ("a.svc.cluster.local", True), ("10:20", False), ("x", False), ("", False), ("MONGODB+SRV://x", True)])
    many(spark, predicates.noise_path, [("src/main.go", False), ("x/tests/a.go", True), ("test_a.py", True), ("a_test.go", True), ("demo/x", True)])
    many(spark, predicates.test_path, [("a/b_test.go", True), ("a.spec.ts", True), ("src/a.go", False), ("tests/x.py", True), ("test_x.py", True)])
    many(spark, predicates.generated_path, [("a.pb.go", True), ("a_pb2.py", True), ("a.go", False)])


@pytest.mark.parametrize("pattern,text,want", [("*", "x", True), ("a*", "abc", True), ("*c", "abc", True), ("*a", "aXa", False), ("a*c", "abbc", True), ("a*b*c", "a1b2c", True), ("a*b*c", "acb", False), ("x", "x", True), ("x", "xy", False), ("*.*", "a.b", True)])
def test_globs(spark, pattern, text, want):
    assert one(spark, text, lambda c: predicates.glob(c, pattern)) is want


def test_templates(spark):
    cases = [("plain", "plain"), ('{{ .Values.x | default "v" }}', "v"), ("{{ .x | default 8080 }}", "8080"), ("{{ .Values.host }}", ".Values.host"), ("http://{{ .h }}:1", "http://{{ .h }}:1"), ("{{ default `q` .x }}", "q")]
    many(spark, predicates.template_value, cases)
    many(spark, predicates.without_templates, [("a{{x}}b{{y}}", "a{template}b{template}"), ("a{{x", "a{{x")])


def test_kinds(spark):
    many(spark, classify.resource_kind, [("UserProto", "grpc_client"), ("redis-api", "http_client"), ("JobQueue", "kafka_producer"), ("zzz", "unknown"), ("ws://x", "websocket_client")])
    many(spark, classify.endpoint_kind, [("RegisterFooServer", "grpc_server"), ("add_X_to_server", "grpc_server"), ("/news", "websocket_server"), ("/a", "http")])
    many(spark, classify.endpoint_parts, [("GET /a", ("GET", "/a")), ("POST/a", ("POST", "/a")), ("/a", (None, "/a")), ("GETTER", (None, "GETTER")), ("topic", (None, "topic"))])
    many(spark, classify.grpc_service, [("NewFooClient", "Foo"), ("pb.RegisterFooServer", "Foo"), ("add_FooServicer_to_server", "Foo"), ("x.FooStub", "Foo"), ("NewClient", None), ("foo", None)])
    many(spark, classify.address_kind, [("wss://x", "websocket_client"), ("grpc://x", "grpc_client"), ("h:6379", "redis"), ("postgres://x", "database"), ("http://x", "http_client")])
    many(spark, lambda c: classify.kind_matches(c, "http"), [("http_client", True), ("HTTP", True), ("grpc_client", False)])


def test_calls(spark):
    cases = [("grpc", "Dial", "", "grpc_client"), ("pb", "RegisterFooServer", "", "grpc_server"), ("x", "get", "/a", "http_client"), ("axios", "post", "", "http_client"), ("app", "listen", ":80", "http_server"), ("wsConn", "connect", "", "websocket_client")]
    cases += [("kafkaProducer", "sendMessage", "", "kafka_producer"), ("db", "open", "", "database"), ("", "dial", "", "tcp_dial"), ("s3client", "upload", "", None), ("s3", "upload", "", "s3"), ("foo", "bar", "", None), ("sqs", "receive", "", "sqs"), ("ioredis", "NewPool", "", "redis")]
    df = spark.createDataFrame(cases, "r string, m string, a string, want string")
    for row in df.select("*", classify.call_kind(F.col("r"), F.col("m"), F.col("a")).alias("got")).collect():
        assert row.got == row.want, row
    none = F.array().cast("array<string>")
    seen = df.select(classify.may_be_network(F.lit("x"), F.lit("NewConnPool"), F.lit(""), none), classify.may_be_network(F.lit("x"), F.lit("foo"), F.lit("h:80"), none), classify.may_be_network(F.lit("x"), F.lit("foo"), F.lit("a"), F.array(F.lit("net/http"))), classify.may_be_network(F.lit("x"), F.lit("foo"), F.lit("a"), none)).first()
    assert tuple(seen) == (True, True, True, False)
