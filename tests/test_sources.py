import json

import pytest
from pyspark.sql import functions as F

from latticework import errors
from latticework.plans import commands
from latticework.sources import code, files, infra, lines, store
from latticework.streaming import incremental

FILES = "repo string, file string, content string"


def of(spark, *rows):
    return spark.createDataFrame([("r", f, c) for f, c in rows], FILES)


def facts(spark, file, content):
    df = of(spark, (file, content)).withColumn("language", files.language(F.col("file")))
    return code.facts(df)


def test_scan_and_ignore(spark, tmp_path):
    for name in ("a.go", ".hidden/x.py", "build/out.js", "src/keep/b.yaml", "src/skip.log", ".git/config"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.scan(spark, f"file://{tmp_path}", "r", ["build/", "*.log", "# note"])
    assert {r.file for r in found.collect()} == {"a.go", ".hidden/x.py", "src/keep/b.yaml"}
    routed = {r.file: (r.route, r.language) for r in files.routed(found).collect()}
    assert routed == {"a.go": ("code", "go"), ".hidden/x.py": ("code", "python"), "src/keep/b.yaml": ("infra", None)}


def test_cluster_services_and_variables(spark):
    text = "kind: Service\nmetadata:\n  name: web\nspec:\n  ports:\n  - name: http\n    port: 80\n  selector:\n    app: web\n---\nkind: Deployment\nmetadata:\n  name: frontend\nspec:\n  template:\n    spec:\n      containers:\n      - name: server\n        image: \"gcr.io/x/y:1\"\n        env:\n        - name: PRODUCT_CATALOG_SERVICE_ADDR\n          value: \"productcatalogservice:3550\"\n        - name: TOKEN\n          valueFrom: {}\n"
    df = of(spark, ("k.yaml", text))
    (s,) = infra.services(df).collect()
    assert (s.name, s.namespace, s.ports, s.selector, s.line) == ("web", "default", [80], {"app": "web"}, 1)
    assert [(r.deployment_name, r.var_name, r.value, r.line) for r in infra.env_bindings(df).collect()] == [("frontend", "PRODUCT_CATALOG_SERVICE_ADDR", "productcatalogservice:3550", 21)]
    assert [r.var_name for r in infra.secret_variables(df).collect()] == ["TOKEN"]
    assert [r.image_ref for r in infra.container_images(df).collect()] == ["gcr.io/x/y:1"]


def test_protos(spark):
    df = of(spark, ("a.proto", 'package p.v1;\nservice A {\n rpc Get (X) returns (Y);\n // rpc No (X) returns (Y);\n}\nmessage M { }\nservice B {\n  rpc Put(X) returns (Y) {}\n}\n'))
    assert [r.name for r in infra.protos(df).orderBy("line").collect()] == ["p.v1.A.Get", "p.v1.B.Put"]
    assert {r.fqn: r.methods for r in infra.proto_services(df).collect()} == {"p.v1.A": ["Get"], "p.v1.B": ["Put"]}


def test_dependencies(spark):
    df = of(
        spark,
        ("go.mod", "module m\nrequire github.com/a/b v1.2.3\nrequire (\n\tgithub.com/c/d v0.1.0 // indirect\n)\n"),
        ("package.json", '{"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}}'),
        ("requirements.txt", "# c\nflask[async]>=2 ; python_version > '3'\n-r other.txt\nnumpy\n"),
        ("pyproject.toml", '[project]\nname = "z"\ndependencies = [\n  "httpx>=0.2",\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n[tool.poetry.dependencies]\npython = "^3"\nrich = "^13"\n'),
    )
    got = {(r.name, r.version, r.is_dev) for r in infra.dependencies(df).collect()}
    assert got == {("github.com/a/b", "v1.2.3", False), ("github.com/c/d", "v0.1.0", False), ("x", "^1", False), ("y", "2", True), ("flask", ">=2", False), ("numpy", "", False), ("httpx", ">=0.2", False), ("pytest", "", True), ("rich", "^13", False)}


def test_python_code(spark):
    text = 'import os\nfrom a.b import c as d\nURL = "http://x"\nclass K:\n    def m(self):\n        return requests.post(f"http://svc/{x}/y", "z")\n@app.get("/items")\ndef items():\n    os.environ["HOST"]\n    os.getenv("PORT")\n    helper()\ndef helper(): pass\npb2.FooStub(channel)\n'
    found = facts(spark, "m.py", text)
    rows = {(r.fact, r.name, r.owner) for r in found.collect()}
    assert {("type", "K", None), ("method", "m", None), ("function", "items", None), ("constant", "URL", None), ("decorator", "app.get", "items"), ("import", "d", None)} <= rows
    assert {r.var_name for r in code.env_reads(found).collect()} == {"HOST", "PORT"}
    assert [(r.method, r.path) for r in code.http_routes(found).collect()] == [("GET", "/items")]
    assert [(r.method, r.path, r.owner) for r in code.http_calls(found).collect()] == [("POST", "/{}/y", "m")]
    assert [(r.side, r.service_name) for r in code.grpc_sites(found).collect()] == [("client", "Foo")]
    done, left = code.same_file_calls(found)
    assert [(r.caller, r.callee) for r in done.collect()] == [("items", "helper")] and ("m", "post") in {(r.caller, r.name) for r in left.collect()}
    assert [r.fact for r in facts(spark, "bad.py", "def (:").collect()] == ["unparsed"]


def test_go_code(spark):
    text = 'package main\n\nimport (\n\t"net/http"\n\tpb "example.com/gen"\n)\n\n// http.Get("no")\nfunc (s *Server) run() {\n\thttp.HandleFunc("/hello", s.hello)\n\trouter.Get("/v1/x", h)\n\thttp.Get("http://orders/v1")\n\tpb.NewOrdersClient(conn)\n\tos.Getenv("DB_URL")\n}\nfunc main() { run() }\ntype T struct {\n}\nconst Name = "v"\n'
    found = facts(spark, "main.go", text)
    assert {(r.name, r.line, r.end_line) for r in found.where("fact = 'function'").collect()} == {("run", 9, 15), ("main", 16, 20)}
    assert {r.value for r in found.where("fact = 'import'").collect()} == {"net/http", "example.com/gen"}
    assert {r.path for r in code.http_routes(found).collect()} == {"/hello", "/v1/x"}
    assert [r.path for r in code.http_calls(found).collect()] == ["/v1"]
    assert [r.var_name for r in code.env_reads(found).collect()] == ["DB_URL"]
    assert [r.service_name for r in code.grpc_sites(found).collect()] == ["Orders"]
    assert found.where("fact = 'type'").first().name == "T" and found.where("fact = 'constant'").first().value == "v"


def test_other_languages(spark):
    ts = facts(spark, "app/api/users/route.ts", "import axios from 'axios';\nconst x = require('ws');\nexport async function GET(req) {\n  await fetch('https://api/v2/u');\n  return process.env.TOKEN;\n}\napp.post('/login', f);\n")
    assert [r.name for r in code.nextjs_routes(ts).collect()] == ["GET /api/users"]
    assert [r.path for r in code.http_routes(ts).collect()] == ["/login"] and [r.path for r in code.http_calls(ts).collect()] == ["/v2/u"]
    assert [r.var_name for r in code.env_reads(ts).collect()] == ["TOKEN"] and {r.name for r in ts.where("fact = 'import'").collect()} == {"axios", "x"}
    cpp = facts(spark, "m.cpp", '#include <grpc.h>\n/* int no() {\n} */\nint Server::start(int a) {\n  connect("host:1");\n  getenv("H");\n}\nclass K {\n};\n')
    assert [r.name for r in cpp.where("fact = 'function'").collect()] == ["start"] and [r.name for r in cpp.where("fact = 'type'").collect()] == ["K"]
    java = facts(spark, "K.java", 'import java.net.URL;\npublic class K {\n  public void run(String a) throws X {\n    client.send("x");\n  }\n}\n')
    assert [r.name for r in java.where("fact = 'function'").collect()] == ["run"] and [r.value for r in java.where("fact = 'call'").collect()] == ["x"]


def test_context_clamps_at_ends(spark):
    text = lines.lines_of(of(spark, ("f", "\n".join(f"l{k}" for k in range(1, 41)))))
    sites = spark.createDataFrame([("f", 1), ("f", 20), ("f", 40)], "file string, line int")
    got = {r.line: (r.lines[0].line, r.lines[-1].line) for r in lines.context(text, sites).collect()}
    assert got == {1: (1, 15), 20: (5, 34), 40: (25, 40)}


def test_stored_graph(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 3, "a", 0), (2, 3, "b", 1)], "id bigint, kind int, name string, repo int")
    edges = spark.createDataFrame([(1, 2, 1)], "src bigint, dst bigint, kind int")
    path = f"file://{tmp_path}/g"
    with pytest.raises(errors.NoIndex):
        store.load_graph(spark, path)
    store.write_graph(nodes, edges, path)
    n, e = store.load_graph(spark, path, verify=True)
    assert (n.count(), e.count()) == (2, 1)
    spark.createDataFrame([(1, 9, 1)], edges.schema).write.mode("append").parquet(f"{path}/edges")
    with pytest.raises(errors.CorruptGraph):
        store.load_graph(spark, path, verify=True)
    spark.createDataFrame([(1, 0, 0, 0)], "version int, n_nodes bigint, n_edges bigint, checksum bigint").write.mode("overwrite").json(f"{path}/header")
    with pytest.raises(errors.VersionMismatch):
        store.load_graph(spark, path)


def test_network_files(spark, tmp_path):
    assert store.load_network(spark, f"file://{tmp_path}/none").count() == 0
    calls = spark.createDataFrame([("f", 1, "redis", "x", "{}", "heuristic", None, 1), ("f", 2, "unknown", "x", "{}", "heuristic", None, 2)], "file string, line int, net_kind string, callee_fqn string, address_source string, confidence string, repo string, seq bigint")
    store.write_network(calls, f"file://{tmp_path}/n")
    assert store.load_network(spark, f"file://{tmp_path}/n").count() == 1
    (tmp_path / "r").mkdir()
    for name in ("one", "two"):
        (tmp_path / "r" / f"{name}.network.json").write_text('{"file":"f","line":1,"net_kind":"redis","seq":1}\n')
    assert [r.file for r in store.load_remote_networks(spark, f"file://{tmp_path}/r").collect()] == ["[one] f"]
    with pytest.raises(errors.ConfigError):
        store.custom_rules(spark, "not toml [", strict=True)
    with pytest.warns(UserWarning):
        assert store.custom_rules(spark, "not toml [").count() == 0
    assert 'fqn = "x"' in store.rule_template(spark.createDataFrame([("x", "f", 1, 3)], "callee_fqn string, file string, line int, n bigint"))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "concat('k', id % 7) as k", "timestamp_seconds(id + 86400) as ts")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = incremental.changes(spark, f"{tmp_path}/in", "id bigint, k string, ts timestamp", 2)
    got = incremental.stored_counts(spark, stream, ["k"], f"{tmp_path}/out", f"{tmp_path}/cp")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.groupBy("k").count().collect()}
    assert [incremental.policy(*x) for x in ((10, 10**6, 100, 1), (5000, 10000, 100, 1), (1, 10, 100, 60))] == ["overlay", "merge", "rebuild"]
    seen = []
    windows = incremental.windowed_counts(stream, "ts", ["k"], "5 minutes", "0 seconds")
    query = windows.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.table("windows").agg(F.sum("n")).first()[0]
    assert seen and seen <= 1000
    twice = incremental.changes(spark, f"{tmp_path}/in", "id bigint, k string, ts timestamp", 5).selectExpr("explode(array(id, id)) as id", "ts")
    once = incremental.once_each(twice, ["id"], "ts", "1 hour")
    query = once.writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp3").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 1000


def test_maintained_facts(spark, tmp_path):
    schema = "file string, name string"
    versions = [[("a", "x"), ("a", "y"), ("b", "z")], [("a", "y"), ("a", "w")], [("c", "q")]]
    for k, rows in enumerate(versions):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.changes(spark, f"{tmp_path}/in", schema, 1)
        incremental.maintain(spark, stream, ["file", "name"], f"{tmp_path}/out", f"{tmp_path}/cp", buckets=4)
    assert {(r.file, r.name) for r in incremental.maintained(spark, f"{tmp_path}/out").collect()} == {("a", "y"), ("a", "w"), ("b", "z"), ("c", "q")}
    second = spark.read.parquet(f"{tmp_path}/out/changes").where("batch = 1")
    assert {(r.file, r.name, r.change) for r in second.collect()} == {("a", "w", "added"), ("a", "x", "removed")}


def test_network_files_are_arrays_or_lines_or_nothing(spark, tmp_path):
    call = lambda k: {"file": f"f{k}.go", "line": k, "net_kind": "http_client", "callee_fqn": "net/http.Get", "address_source": "{}", "confidence": "heuristic", "repo": "r", "seq": k}
    texts = {
        "pretty": json.dumps([call(1), call(2)], indent=2),
        "short": json.dumps([call(3)]),
        "lines": json.dumps(call(4)) + "\n" + json.dumps(call(5)) + "\n",
        "bad": "{oops",
        "other": json.dumps([{"what": 1}], indent=2),
        "none": "[]",
        "empty": "",
        "cut": json.dumps([call(6), call(7)], indent=2)[:-40],
    }
    want = {"pretty": [1, 2], "short": [3], "lines": [4, 5]}
    for name, text in texts.items():
        (tmp_path / f"{name}.network.json").write_text(text)
        rows = store.load_network(spark, f"file://{tmp_path}/{name}.network.json").collect()
        assert sorted(r.line for r in rows) == want.get(name, []), name
        assert all(r.asDict() == call(r.line) for r in rows)
    assert store.load_network(spark, f"file://{tmp_path}/missing.json").count() == 0
    remote = store.load_remote_networks(spark, f"file://{tmp_path}").collect()
    assert sorted(r.file for r in remote) == ["[lines] f4.go", "[lines] f5.go", "[pretty] f1.go", "[pretty] f2.go", "[short] f3.go"]
    assert store.load_remote_networks(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_ignore_files(spark, tmp_path):
    names = ["a.log", "keep.log", "src/b.log", "src/x1.o", "src/x9.o", "src/xa.o", "build/out.txt", "build/keep.txt", "doc/build", "deep/a/b/c.tmp", "deep/c.tmp", "lit/#x", "lit/sp ace", "sub/only.txt", "sub/deeper/only.txt", "only.txt", ".env", "sub/.hid/x", "new/v1/gen.go", "new/gen.go", "abc", "abd"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# note\n*.log\n!keep.log\nx[0-8].o\nbuild/\n!build/keep.txt\ndeep/**/*.tmp\n\\#x\n/only.txt\n.env   \nnew/*/gen.go\nab[!c]\n\n")
    (tmp_path / "sub" / ".gitignore").write_text("/only.txt\n.hid\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("x")
    left = {r.file for r in files.scan(spark, f"file://{tmp_path}", "r").collect()}
    gone = {"a.log", "src/b.log", "src/x1.o", "build/out.txt", "build/keep.txt", "deep/a/b/c.tmp", "deep/c.tmp", "lit/#x", "only.txt", ".env", "sub/only.txt", "sub/.hid/x", "new/v1/gen.go", "abd"}
    assert left == {*names, ".gitignore", "sub/.gitignore"} - gone
    assert {r.file for r in files.scan(spark, f"file://{tmp_path}", "r", read_ignores=False).collect()} >= set(names)


def test_services_of_any_indent_and_with_repeated_keys(spark):
    text = "kind: Service\nmetadata:\n    name: far\n    namespace: ns\n    labels:\n        name: other\nspec:\n    selector:\n        app: a\n        app: b\n        tier: t\n    ports:\n    - port: 80\n      name: http\n    - port: 443\n"
    (s,) = infra.services(spark.createDataFrame([("r", "s.yaml", text)], "repo string, file string, content string")).collect()
    assert (s["name"], s.namespace, s.ports, s.selector) == ("far", "ns", [80, 443], {"app": "b", "tier": "t"})


FLOWS = {
    "f.go": ("go", 'const BASE = "http://base/x"\nfunc f(url string) {\n  addr := os.Getenv("ADDR")\n  other := addr\n  http.Get(other)\n  http.Post(BASE, "t", nil)\n  resp, err := dial(q)\n  viper.GetString("db.host")\n  flag.String("port", "1")\n}\nfunc g() {\n  const BASE = "http://own/y"\n  http.Get(BASE)\n}\n'),
    "g.py": ("python", 'import os\nimport requests\nURL = "http://lit/z"\ndef f(target):\n    a = os.environ["HOST"]\n    b = a\n    c = b\n    requests.get(c)\n    requests.post(target)\n    requests.put(URL)\n    requests.head(made())\n'),
    "h.ts": ("typescript", 'const u = process.env.API_URL;\nlet v = u;\naxios.get(v);\n'),
    "bad.py": ("python", 'def broken(:\n    x = os.getenv("OLD")  # (\n    requests.get(x)\n'),
    "none.java": ("java", '// nothing here\nString q = System.getenv("Q");\n'),
}


def test_flows_within_files(spark):
    rows = [("r", f, lang, text) for f, (lang, text) in FLOWS.items()] + [("r", "empty.go", "go", None)]
    found = code.facts(spark.createDataFrame(rows, "repo string, file string, language string, content string")).cache()
    made = {(r.file, r.at, r.name): (r.kind, r.value) for r in code.assignments(found).collect()}
    assert made["f.go", 3, "addr"] == ("env", "ADDR") and made["f.go", 4, "other"] == ("variable", "addr") and made["f.go", 7, "resp"] == ("call", "dial")
    assert made["g.py", 5, "a"] == ("env", "HOST") and made["g.py", 4, "target"] == ("parameter", "f:0") and made["h.ts", 1, "u"] == ("env", "API_URL")
    assert made["none.java", 2, "q"] == ("env", "Q") and made["bad.py", 2, "x"] == ("env", "OLD")
    assert [r.file for r in found.where("fact = 'unparsed'").collect()] == ["bad.py"]
    with_constants = {(r.file, r.line): r.value for r in code.propagated(found).where("fact = 'call' and name in ('Get', 'Post', 'put')").collect()}
    assert with_constants["f.go", 13] == "http://own/y" and with_constants["g.py", 10] == "http://lit/z" and with_constants["f.go", 5] is None
    assert code.propagated(found).count() == found.count()
    reads = {(r.file, r.kind, r.key) for r in code.setting_reads(found).collect()}
    assert {("f.go", "env", "ADDR"), ("f.go", "config", "db.host"), ("f.go", "flag", "port"), ("g.py", "env", "HOST"), ("h.ts", "env", "API_URL")} <= reads
    yaml = spark.createDataFrame([], "repo string, file string, content string")
    calls = {(r.file, r.line): r.address_source for r in commands.network_calls(spark, code.propagated(found), yaml).collect()}
    assert calls["f.go", 5] == '{"EnvVar":{"var_name":"ADDR","k8s_value":null}}' and calls["g.py", 8] == '{"EnvVar":{"var_name":"HOST","k8s_value":null}}'
    assert calls["g.py", 9] == '{"Parameter":{"func":"f","param_idx":0,"caller_sources":[]}}' and calls["g.py", 10] == '{"Literal":{"value":"http://lit/z"}}'
    assert calls["h.ts", 3] == '{"EnvVar":{"var_name":"API_URL","k8s_value":null}}' and calls["g.py", 11] == '{"Dynamic":{"hint":""}}' and calls["bad.py", 3] == '{"EnvVar":{"var_name":"OLD","k8s_value":null}}'
