"""Registered queries of the parsers, of stored graphs and of streams, over files that are spelled out from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import sinks
from latticework.plans import bridge, commands
from latticework.plans.registry import query
from latticework.sources import code, files, infra, store
from latticework.storage import new_dir, stored
from latticework.streaming import incremental


def _files(df: DataFrame, file: str, *lines) -> DataFrame:
    """repo, file and content of one file a row; a line is text or a column."""
    parts = [x if not isinstance(x, str) else F.lit(x) for x in lines]
    return df.select(F.lit("r").alias("repo"), F.expr(file).alias("file"), F.concat_ws("\n", *parts).alias("content"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bridge.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    return _files(
        s, "concat('k8s/', s_suppkey, '.yaml')", "apiVersion: apps/v1", "kind: Deployment", "metadata:", F.concat(F.lit("  name: dep"), key), "spec:", "  containers:", "  - name: main",
        F.concat(F.lit("    image: gcr.io/app"), key, F.lit(":v1")), "    env:", F.concat(F.lit("    - name: A"), key, F.lit("_URL")), F.concat(F.lit('      value: "http://svc'), key, F.lit(':80"')), "    - name: SECRET_HOST", "      valueFrom: {}",
        "---", "kind: Service", "metadata:", F.concat(F.lit("  name: svc"), key), F.concat(F.lit("  namespace: ns"), F.col("s_nationkey").cast("string")), "spec:", "  selector:", F.concat(F.lit("    app: dep"), key), "  ports:", "  - port: 80", "  - port: 443",
    )


@query("select concat('k8s/', s_suppkey, '.yaml') as file, cast(10 as int) as line, concat('dep', s_suppkey) as deployment_name, concat('A', s_suppkey, '_URL') as var_name, concat('http://svc', s_suppkey, ':80') as value from supplier")
def yaml_env_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infra.env_bindings(_manifests(spark, sf_dir)).select("file", "line", "deployment_name", "var_name", "value")


@query("select concat('k8s/', s_suppkey, '.yaml') as file, concat('svc', s_suppkey) as name, concat('ns', s_nationkey) as namespace, '80,443' as ports, concat('dep', s_suppkey) as app from supplier")
def k8s_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infra.services(_manifests(spark, sf_dir))
    return found.select("file", "name", "namespace", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"), F.col("selector")["app"].alias("app"))


@query("select concat('k8s/', s_suppkey, '.yaml') as file, cast(8 as int) as line, concat('gcr.io/app', s_suppkey, ':v1') as image_ref from supplier")
def yaml_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infra.container_images(_manifests(spark, sf_dir)).select("file", "line", "image_ref")


@query("select concat('k8s/', s_suppkey, '.yaml') as file, 'http_client' as net_kind, concat('env:A', s_suppkey, '_URL') as callee_fqn from supplier union all select concat('k8s/', s_suppkey, '.yaml'), 'unknown', 'env:SECRET_HOST' from supplier")
def yaml_network_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infra.network_variables(_manifests(spark, sf_dir)).select("file", "net_kind", "callee_fqn")


@query("select concat('p', n_nationkey, '.proto') as file, concat('pkg.v', n_regionkey) as package, concat('Svc', n_nationkey) as service, m.method, concat('pkg.v', n_regionkey, '.Svc', n_nationkey, '.', m.method) as name from nation cross join (values ('Get'), ('Put')) m(method)")
def proto_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bridge.table(spark, sf_dir, "nation")
    made = _files(
        n, "concat('p', n_nationkey, '.proto')", 'syntax = "proto3";', F.concat(F.lit("package pkg.v"), F.col("n_regionkey").cast("string"), F.lit(";")), F.concat(F.lit("service Svc"), F.col("n_nationkey").cast("string"), F.lit(" {")),
        "  rpc Get (Req) returns (Res);  // rpc Not (A) returns (B);", "  rpc Put(Req) returns (Res) {}", "}", "message Req { string rpc = 1; }",
    )
    return infra.protos(made).select("file", "package", "service", "method", "name")


@query("select concat('d', n_nationkey, '/Dockerfile') as file, concat('base', n_nationkey, ':1') as image_ref, '80,8443' as exposed, 'A=1,B=x y' as env, '[\"run\"]' as cmd from nation")
def dockerfile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bridge.table(spark, sf_dir, "nation")
    made = _files(n, "concat('d', n_nationkey, '/Dockerfile')", F.concat(F.lit("FROM --platform=x base"), F.col("n_nationkey").cast("string"), F.lit(":1 AS b")), "FROM scratch", "EXPOSE 80/tcp 8443", "EXPOSE 80", "ENV A=1", "ENV B x y", 'CMD ["run"]')
    found = infra.dockerfiles(made)
    env = F.array_join(F.transform("env_defaults", lambda e: F.concat_ws("=", e["k"], e["v"])), ",")
    return found.select("file", "image_ref", F.array_join(F.col("exposed_ports").cast("array<string>"), ",").alias("exposed"), env.alias("env"), "cmd")


@query("select concat('m', n_nationkey, '/package.json') as file, concat('lib', n_nationkey) as name, '^1.0' as version, false as is_dev from nation union all select concat('m', n_nationkey, '/package.json'), 'jest', '2', true from nation")
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bridge.table(spark, sf_dir, "nation")
    made = _files(n, "concat('m', n_nationkey, '/package.json')", F.concat(F.lit('{"dependencies": {"lib'), F.col("n_nationkey").cast("string"), F.lit('": "^1.0"}, "devDependencies": {"jest": "2"}}')))
    return infra.dependencies(made).select("file", "name", "version", "is_dev")


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bridge.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    made = _files(
        s, "concat('src/m', s_suppkey, '.py')", "import os", "import requests as rq", "", "def helper():", F.concat(F.lit('    return os.getenv("VAR_'), key, F.lit('")')), "", "def main():", F.concat(F.lit('    rq.get("http://svc'), key, F.lit('/v1/items")')), "    helper()", '@app.route("/x")', "def route(): pass",
    )
    return made.withColumn("language", files.language(F.col("file")))


@query("select concat('src/m', s_suppkey, '.py') as file, m.name, m.receiver, m.owner from supplier cross join (values ('getenv', 'os', 'helper'), ('get', 'rq', 'main'), ('helper', '', 'main')) m(name, receiver, owner)")
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.facts(_python(spark, sf_dir)).where("fact = 'call'")
    return found.select("file", "name", F.coalesce("receiver", F.lit("")).alias("receiver"), F.coalesce("owner", F.lit("")).alias("owner"))


@query("select concat('src/m', s_suppkey, '.py') as file, 'env' as what, concat('VAR_', s_suppkey) as value from supplier union all select concat('src/m', s_suppkey, '.py'), 'call', '/v1/items' from supplier union all select concat('src/m', s_suppkey, '.py'), 'route', '/x' from supplier")
def code_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.facts(_python(spark, sf_dir))
    parts = code.env_reads(found).select("file", F.lit("env").alias("what"), F.col("var_name").alias("value")), code.http_calls(found).select("file", F.lit("call").alias("what"), F.col("path").alias("value")), code.http_routes(found).select("file", F.lit("route").alias("what"), F.col("path").alias("value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select concat('src/m', s_suppkey, '.py') as file, 'get' as callee, 'http_client' as category, 'outbound' as direction, 'registry' as how from supplier")
def sink_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.facts(_python(spark, sf_dir))
    calls = found.where("fact = 'call'").select(F.xxhash64("file", "line", "name").alias("id"), "file", "receiver", F.col("name").alias("callee"), F.col("value").alias("first_arg"))
    imports = found.where("fact = 'import'").select("file", F.col("value").alias("path"), F.col("name").alias("alias"))
    rules = store.custom_rules(spark, "")
    return sinks.told(calls, imports, sinks.builtin(spark), rules).where("how = 'registry'").select("file", "callee", "category", "direction", "how")


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a file of Go, TypeScript, Java, C++ and Python, in each of which a variable goes from where it is set to a call."""
    s = bridge.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    name = lambda text: F.concat(F.lit(text), key)
    go = _files(s, "concat('src/m', s_suppkey, '.go')", "package m", 'import "net/http"', "func call() {", F.concat(name('  addr := os.Getenv("GO_'), F.lit('")')), "  other := addr", "  http.Get(other)", "}")
    ts = _files(s, "concat('src/m', s_suppkey, '.ts')", "import axios from 'axios';", F.concat(name("const base = process.env.TS_"), F.lit(";")), "export async function call() {", "  axios.get(base);", "}")
    java = _files(s, "concat('src/M', s_suppkey, '.java')", "import java.sql.DriverManager;", "class M {", "  public void call() {", F.concat(name('    String url = System.getenv("JAVA_'), F.lit('");')), "    DriverManager.getConnection(url);", "  }", "}")
    cpp = _files(s, "concat('src/m', s_suppkey, '.cpp')", "#include <hiredis.h>", "void call() {", F.concat(name('  const char* host = "cpp'), F.lit('";')), "  redisConnect(host, 6379);", "}")
    py = _files(s, "concat('src/m', s_suppkey, '.py')", "import os, requests", "def call(extra):", F.concat(name('    a = os.environ["PY_'), F.lit('"]')), "    b = a", "    c = b", "    requests.get(c)", "    requests.post(extra)")
    every = go.unionByName(ts).unionByName(java).unionByName(cpp).unionByName(py)
    return every.withColumn("language", files.language(F.col("file")))


@query("select concat('src/', p.prefix, s_suppkey, p.suffix) as file, p.line, p.kind, p.before || case when p.keyed then cast(s_suppkey as varchar) else '' end as value from supplier cross join (values ('m', '.go', 6, 'EnvVar', 'GO_', true), ('m', '.ts', 4, 'EnvVar', 'TS_', true), ('M', '.java', 5, 'EnvVar', 'JAVA_', true), ('m', '.cpp', 4, 'Literal', 'cpp', true), ('m', '.py', 6, 'EnvVar', 'PY_', true), ('m', '.py', 7, 'Parameter', 'call:0', false)) p(prefix, suffix, line, kind, before, keyed)")
def code_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.propagated(stored(code.facts(_flows(spark, sf_dir)), "flows"))
    calls = commands.network_calls(spark, found, spark.createDataFrame([], "repo string, file string, content string"))
    source = lambda path: F.get_json_object("address_source", f"$.{path}")
    value = F.coalesce(source("EnvVar.var_name"), source("Literal.value"), F.concat_ws(":", source("Parameter.func"), source("Parameter.param_idx")))
    told = calls.where("not lower(callee_fqn) like '%env%'")
    return told.select("file", F.col("line").cast("int").alias("line"), F.regexp_extract("address_source", r'^\{"(\w+)"', 1).alias("kind"), value.alias("value"))


@query(f"select file, line, net_kind, callee_fqn, address_source, confidence, repo, seq from ({bridge.oracle(bridge.CALLS)}) c where net_kind <> 'unknown'")
def network_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "network")
    store.write_network(bridge.calls(spark, sf_dir), path)
    return store.load_network(spark, path)


@query("select 'all' as library, cast(375 as bigint) as n union all select 'routes', 75")
def registry_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sinks.builtin(spark).select(F.lit("all").alias("library")).unionAll(sinks.builtin_routes(spark).select(F.lit("routes").alias("library")))
    return both.groupBy("library").agg(F.count("*").alias("n"))


@query(f"select src, dst, kind, confidence, flags from ({bridge.oracle(bridge.EDGES)}) e")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "graph")
    store.write_graph(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir), path)
    _, edges = store.load_graph(spark, path, verify=True)
    return edges.select("src", "dst", "kind", "confidence", "flags")


@query("select event_type, count(*) as n from events group by event_type")
def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bridge.table(spark, sf_dir, "events")
    folder = new_dir(spark, "incoming")
    events.repartition(4).write.parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = incremental.changes(spark, folder, schema, 2)
    return incremental.stored_counts(spark, stream, ["event_type"], new_dir(spark, "counts"), new_dir(spark, "stream"))


@query("select file, name, change from (select 'f' || (o_custkey % 20) as file, 'n' || o_orderkey as name, 'removed' as change from orders where o_orderkey % 4 = 0 and o_custkey % 20 < 10) where file in (select 'f' || (o_custkey % 20) from orders where o_orderkey % 4 <> 0 and o_custkey % 20 < 10)")
def fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bridge.table(spark, sf_dir, "orders")
    facts = orders.select(F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("file"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey", "o_custkey")
    after = facts.where("o_orderkey % 4 <> 0 and o_custkey % 20 < 10")
    return incremental.fact_changes(facts.select("file", "name"), after.select("file", "name"), ["file", "name"])
