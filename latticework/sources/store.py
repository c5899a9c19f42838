"""Stored graphs, network files, indexes and rule files."""

from __future__ import annotations

import tomllib
import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework import model
from latticework.errors import ConfigError, CorruptGraph, NoIndex, VersionMismatch

VERSION = 2
#: Facts that other repositories can meet, as index_facts() gives them.
INDEX = "map_name string, key string, repo_id string, repo_name string, file string, line int, symbol string"
CATEGORIES = ("http_client", "http_server", "grpc_client", "grpc_server", "websocket_client", "websocket_server", "kafka_producer", "kafka_consumer", "database", "redis", "sqs", "s3", "tcp_dial", "tcp_listen", "unknown")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet by repo, nodes in the order of kind and name, edges in that of source, kind and target; a header tells version and counts."""
    nodes.select(nodes.columns).sortWithinPartitions("repo", "kind", "name").write.mode("overwrite").partitionBy("repo").parquet(f"{path}/nodes")
    edges.repartitionByRange("src").sortWithinPartitions("src", "kind", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession  # counted as written, so that what made the graph runs once
    n = spark.read.schema(nodes.schema).parquet(f"{path}/nodes").count()
    e, check = spark.read.schema(edges.schema).parquet(f"{path}/edges").agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst", "kind")), F.lit(0))).first()
    nodes.sparkSession.createDataFrame([(VERSION, n, e, check)], "version int, n_nodes bigint, n_edges bigint, checksum bigint").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def load_graph(spark: SparkSession, path: str, verify: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; verify also counts them and checks that edges are as they were written and end in nodes."""
    try:
        header = spark.read.schema("version int, n_nodes bigint, n_edges bigint, checksum bigint").json(f"{path}/header").first()
    except Exception as e:
        raise NoIndex(f"no graph at {path}") from e
    if header is None or header.version != VERSION:
        raise VersionMismatch(f"{path} has version {header and header.version}, not {VERSION}")
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if verify:
        n_edges, check = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst", "kind")), F.lit(0))).first()
        if (nodes.count(), n_edges, check) != (header.n_nodes, header.n_edges, header.checksum):
            raise CorruptGraph(f"{path} does not hold what its header says")
        ids = nodes.select(F.col("id").alias("end"))
        if not edges.select(F.explode(F.array("src", "dst")).alias("end")).join(ids, "end", "left_anti").isEmpty():
            raise CorruptGraph(f"edges of {path} end outside its nodes")
    return nodes, edges


def write_network(calls: DataFrame, path: str) -> None:
    """Calls as JSON lines; those of unknown kind are left out."""
    calls.where("net_kind <> 'unknown'").write.mode("overwrite").json(path)


def load_network(spark: SparkSession, path: str) -> DataFrame:
    """Calls of JSON files, each an array (on one line or many), an object or a line of JSON for each call; empty where there are none.

    A file that is no JSON, or an array that holds something else than calls, gives no rows.
    """
    return _read_calls(spark, path).drop("remote")


def _read_calls(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Calls and remote, the name of their file. Files of lines are split among tasks; those that hold an array, which may span lines, are read whole."""
    fields = [f.split() for f in model.NETWORK_CALLS.split(", ")]
    try:
        lines = spark.read.options(**options).text(path).select(F.trim(F.regexp_replace("value", r"^\x{FEFF}", "")).alias("value"), F.col("_metadata.file_path").alias("path"))
    except AnalysisException:  # there is no such path
        return spark.createDataFrame([], model.NETWORK_CALLS + ", remote string")
    one = ", ".join(f"{n}:{t}" for n, t in fields)
    arrays = [r.path for r in lines.where("value like '[%'").select("path").distinct().collect()]  # a path for each network of a remote
    single = lines.where(~F.col("path").isin(arrays)) if arrays else lines
    calls = single.select("path", F.from_json(F.rtrim(F.col("value"), F.lit(", ")), f"struct<{one}>").alias("call"))
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\A\x{FEFF}", "").alias("value"))
        calls = calls.union(whole.select("path", F.explode(F.from_json("value", f"array<struct<{one}>>")).alias("call")))
    remote = F.regexp_extract("path", r"([^/]+)\.network\.json(?:/[^/]+)?$", 1).alias("remote")
    return calls.where("call.file is not null and call.line is not null").select("call.*", remote)


def load_remote_networks(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of ``NAME.network.json`` files, their file marked ``[NAME]``; of calls at one place the first counts."""
    rows = _read_calls(spark, folder, recursiveFileLookup="true").where("remote <> ''")
    first = Window.partitionBy("file", "line").orderBy("remote", "seq")
    rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.withColumn("file", F.concat(F.lit("["), "remote", F.lit("] "), "file")).select(*(f.split()[0] for f in model.NETWORK_CALLS.split(", ")))


def custom_rules(spark: SparkSession, text: str, strict: bool = False) -> DataFrame:
    """pos, fqn, category, addr_arg and direction of ``[[sinks]]`` in TOML; a rule of an unknown category is left out, and any direction but inbound is outbound.

    A text that is no TOML has no rules and is warned of, unless strict.
    """
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        if strict:
            raise ConfigError(f"rules cannot be read: {e}") from e
        warnings.warn(f"rules cannot be read, so there are none: {e}", stacklevel=2)
        data = {}
    rows = []
    for pos, r in enumerate(data.get("sinks", [])):
        if r.get("category") in CATEGORIES and r.get("fqn"):
            rows.append((pos, r["fqn"], r["category"], int(r.get("addr_arg", 0)), "inbound" if r.get("direction") == "inbound" else "outbound"))
    return spark.createDataFrame(rows, "pos int, fqn string, category string, addr_arg int, direction string")


def rule_template(callees: DataFrame, most: int = 50) -> str:
    """TOML to fill in for the callees that no rule knows."""
    out = []
    for r in callees.orderBy(F.desc("n"), "callee_fqn").limit(most).collect():
        out.append(f'# {r.file}:{r.line}, {r.n} calls\n[[sinks]]\nfqn = "{r.callee_fqn}"\ncategory = "unknown"\naddr_arg = 0\ndirection = "outbound"\n')
    return "\n".join(out)


def index_facts(nodes: DataFrame, repo_names: DataFrame) -> DataFrame:
    """map_name, key, repo_id, repo_name, file, line and symbol of what other repos can meet: endpoints and resources by name."""
    kinds = F.when(F.col("kind") == int(model.NodeKind.ENDPOINT), "endpoints").when(F.col("kind") == int(model.NodeKind.RESOURCE), "env_vars").when(F.col("kind") == int(model.NodeKind.SURFACE), "surfaces")
    named = nodes.withColumn("map_name", kinds).where("map_name is not null").join(repo_names, nodes["repo"] == repo_names["repo_id"])
    return named.select("map_name", F.col("name").alias("key"), "repo_id", "repo_name", "file", "line", F.col("name").alias("symbol"))


def without_repo(rows: DataFrame, repo_id: int) -> DataFrame:
    """Rows of an index, or of an overlay, without those that have an end in a repository."""
    ends = [c for c in ("repo_id", "source_repo_id", "target_repo_id") if c in rows.columns]
    return rows.where(reduce(lambda a, b: a & b, [F.col(c) != repo_id for c in ends]))


def write_index(index: DataFrame, path: str) -> None:
    """The facts of an index, or the edges of an overlay, as JSON lines by repository."""
    index.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    """What write_index() wrote; empty where there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:  # there is no such path
        return spark.createDataFrame([], schema)


def add_remote(spark: SparkSession, calls: DataFrame, name: str, folder: str) -> str:
    """Keeps a remote's calls among the networks of the folder, in place of what it had there before; the path."""
    if "/" in name or not name:
        raise ConfigError(f"{name!r} is no name of a remote")
    path = f"{folder}/{name}.network.json"
    write_network(calls, path)
    return path
