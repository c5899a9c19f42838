from pyspark.sql import functions as F

from latticework.functions import paths
from latticework.model import ALL_EDGES
from latticework.operators import graph, provenance, traverse
from latticework.plans import commands
from latticework.sources import store

# 1 and 2 are services that hold symbols 10, 11 and 20; 30 is a surface, 40 an endpoint, 50 and 51 variables.
NODES = [(1, 1, None), (2, 1, None), (10, 3, 1), (11, 3, 1), (20, 3, 2), (30, 5, None), (40, 4, 1), (50, 7, None), (51, 6, None)]
EDGES = [(30, 10, 3), (30, 20, 3), (10, 11, 1), (11, 40, 4), (11, 50, 6), (51, 2, 6), (20, 99, 3)]


def graph_of(spark):
    nodes = spark.createDataFrame([(i, k, f"n{i}", p) for i, k, p in NODES], "id bigint, kind int, name string, parent bigint")
    return nodes, spark.createDataFrame(EDGES, "src bigint, dst bigint, kind int")


def test_impact_classes(spark):
    nodes, edges = graph_of(spark)
    found = {(r["class"], r.id, r.detail) for r in traverse.impact_classes(nodes, edges, 30).collect()}
    assert found == {
        ("symbol", 10, None), ("symbol", 11, None), ("symbol", 20, None), ("endpoint", 40, None), ("resource", 50, None), ("service", 1, None), ("service", 2, None),
        ("config", 50, 1), ("config", 51, 2), ("skew", 1, 30), ("skew", 2, 30),
    }
    alone = {(r["class"], r.id) for r in traverse.impact_classes(nodes, edges, 10).collect()}
    assert alone == {("symbol", 11), ("endpoint", 40), ("resource", 50), ("service", 1), ("config", 50)}
    assert traverse.impact_classes(nodes, edges, 40).count() == 0


def test_gaps(spark):
    nodes, edges = graph_of(spark)
    reached = traverse.reach(edges, traverse.seeds_of(spark, [30]))
    assert [tuple(r) for r in graph.gaps(nodes, edges, reached, ALL_EDGES).collect()] == [(20, 99, 3)]
    assert graph.gaps(nodes, edges, reached, 1 << 1).count() == 0


def test_names_of_repositories(spark):
    df = spark.createDataFrame([("/src/web/", "https://host/org/api.git"), ("", "git@host:org/x.git"), ("one", "plain/dir")], "path string, url string")
    rows = df.select(paths.repo_name(F.col("path")), paths.graph_name(F.lit(7), F.col("path")), paths.is_git_url(F.col("url")), paths.repo_name_of_url(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [("web", "0007-web", True, "api"), ("repo", "0007-repo", True, "x"), ("one", "0007-one", False, "dir")]


def test_chains_in_the_style_of_traces(spark):
    long = "h" * 60
    cases = [
        ('{"Literal":{"value":"' + long + '"}}', '"' + "h" * 50 + '..."'),
        ('{"EnvVar":{"var_name":"A","k8s_value":null}}', "env(A)"),
        ('{"EnvVar":{"var_name":"A","k8s_value":"' + long + '"}}', 'env(A) = "' + "h" * 40 + '..."'),
        ('{"Parameter":{"func":"f","param_idx":1,"caller_sources":[{"EnvVar":{"var_name":"B","k8s_value":null}},{"Dynamic":{"hint":""}}]}}', "f.param[1] <- [env(B), dynamic]"),
        ('{"FieldAccess":{"type_name":"T","field":"u","assignment_sources":[]}}', "T.u"),
        ('{"Concat":{"parts":[{"Literal":{"value":"a"}},{"ConfigKey":{"key":"k","file":null}}]}}', '"a" + config(k)'),
        ('{"Flag":{"flag_name":"p","default_value":"1"}}', 'flag(p, default="1")'),
        ('{"ServiceDiscovery":{"service_name":"s","mechanism":"dns"}}', "svc_discovery(s, dns)"),
        ('{"Dynamic":{"hint":"x"}}', "dynamic(x)"),
        ("no json", None),
        (None, None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.line for r in df.select("k", provenance.traced("t").alias("line")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_remotes_and_indexes(spark, tmp_path):
    calls = spark.createDataFrame([("a.go", 1, "http_client", "net/http.Get", "{}", "heuristic", "r", 1), ("b.go", 2, "unknown", "f", "{}", "heuristic", "r", 2)], "file string, line int, net_kind string, callee_fqn string, address_source string, confidence string, repo string, seq bigint")
    store.write_network(calls, f"file://{tmp_path}/saved/network")
    found = commands.pull(spark, {"one": f"file://{tmp_path}/saved/network", "two": f"file://{tmp_path}/saved/network"}, f"file://{tmp_path}/remotes").collect()
    assert sorted(r.file for r in found) == ["[one] a.go"]  # of calls at one place the first remote counts
    again = commands.pull(spark, {"one": f"file://{tmp_path}/nowhere"}, f"file://{tmp_path}/remotes").collect()
    assert sorted(r.file for r in again) == ["[two] a.go"]
    index = spark.createDataFrame([("endpoints", "k", "1", "web", "f", 1, "s"), ("endpoints", "k", "2", "api", "g", 2, "t")], store.INDEX)
    store.write_index(index, f"file://{tmp_path}/index")
    back = store.load_index(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect()))
    assert [r.repo_id for r in store.without_repo(back, "1").collect()] == ["2"] and store.load_index(spark, f"file://{tmp_path}/none").count() == 0
    overlay = spark.createDataFrame([("1", "2", "k"), ("2", "3", "k")], "source_repo_id string, target_repo_id string, key string")
    assert [r.source_repo_id for r in store.without_repo(overlay, "1").collect()] == ["2"]
