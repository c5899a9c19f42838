"""The graph and its facts as views over a star schema of sales tables, in SQL that Spark and other engines read alike.

Nodes: regions are repos, nations modules, suppliers deployables, customers symbols, orders endpoints and parts resources; an id is
kind * 10^9 + key. Tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NODES = """
select cast(r_regionkey as bigint) as id, 0 as kind, r_name as name, cast(null as bigint) as parent, cast(r_regionkey as int) as repo from {region}
union all select 2000000000 + n_nationkey, 2, n_name, cast(n_regionkey as bigint), cast(n_regionkey as int) from {nation}
union all select 1000000000 + s_suppkey, 1, s_name, 2000000000 + s_nationkey, cast(n_regionkey as int) from {supplier} join {nation} on s_nationkey = n_nationkey
union all select 3000000000 + c_custkey, 3, c_name, 1000000000 + (c_custkey % (select count(*) from {supplier})), cast(n_regionkey as int) from {customer} join {nation} on c_nationkey = n_nationkey
union all select 4000000000 + o_orderkey, 4, concat('/api/o/', cast(o_orderkey as varchar(20))), 3000000000 + o_custkey, cast(n_regionkey as int)
  from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
union all select 7000000000 + p_partkey, 7, p_name, cast(null as bigint), -1 from {part}
"""

EDGES = """
select src, dst, kind, cast(max(conf) as int) as confidence, 0 as flags from (
select cast(n_regionkey as bigint) as src, 2000000000 + n_nationkey as dst, 0 as kind, 255 as conf from {nation}
union all select 2000000000 + s_nationkey, 1000000000 + s_suppkey, 0, 255 from {supplier}
union all select 1000000000 + (c_custkey % (select count(*) from {supplier})), 3000000000 + c_custkey, 0, 255 from {customer}
union all select 3000000000 + c_custkey, 3000000000 + ((7 * c_custkey + 13 + j * 3571) % (select count(*) from {customer})), 1, 255 from {customer} cross join (values (0), (1), (2)) t(j)
union all select 1000000000 + s_suppkey, 1000000000 + ((3 * s_suppkey + 1) % (select count(*) from {supplier})), 3, 255 from {supplier}
union all select 1000000000 + s_suppkey, 1000000000 + ((s_suppkey + 1) % (select count(*) from {supplier})), 3, 255 from {supplier} where s_suppkey % 4 = 0
union all select 3000000000 + o_custkey, 4000000000 + o_orderkey, 4, 255 from {orders}
union all select 4000000000 + l_orderkey, 7000000000 + l_partkey, 5, (l_linenumber * 36) % 256 from {lineitem}
union all select 1000000000 + l_suppkey, 7000000000 + l_partkey, 8, (l_linenumber * 36) % 256 from {lineitem}
) e where src <> dst group by src, dst, kind
"""

#: Edges of symbols that connect to parts and read parts as if they were address variables: for the Resolves passes.
ENV_EDGES = """
select src, dst, kind from (select src, dst, kind from ({edges}) e where kind = 1
union all select 3000000000 + o_custkey, 7000000000 + (o_orderkey % 97), 8 from {orders} where o_orderkey % 5 = 0
union all select 3000000000 + o_custkey, 7000000000 + 100 + (o_orderkey % 53), 6 from {orders} where o_orderkey % 7 = 0) x group by src, dst, kind
"""

#: Network calls: a row for each order, so that seq is a key.
CALLS = """
select concat(case when o_orderkey % 9 = 0 then 'vendor/' when o_orderkey % 11 = 0 then 'pkg/tests/' else 'src/' end, 's', cast(o_custkey % 40 as varchar(20)), '.go') as file,
  cast(o_orderkey % 50 as int) as line,
  case cast(o_orderkey % 7 as int) when 0 then 'http_client' when 1 then 'http_server' when 2 then 'grpc_client' when 3 then 'database' when 4 then 'kafka_producer' when 5 then 'websocket_server' else 'unknown' end as net_kind,
  concat('pkg.Fn', cast(o_custkey % 13 as varchar(20))) as callee_fqn,
  case cast(o_orderkey % 3 as int) when 0 then concat('{{"EnvVar":{{"var_name":"V', cast(o_custkey % 20 as varchar(20)), '","k8s_value":null}}}}')
    when 1 then '{{"Literal":{{"value":"http://a"}}}}' else '{{"Dynamic":{{"hint":""}}}}' end as address_source,
  case cast(o_custkey % 4 as int) when 0 then 'heuristic' when 1 then 'import_resolved' when 2 then 'llm_classified' else 'type_confirmed' end as confidence,
  cast(case when o_orderkey % 4 = 0 then null else concat('repo', cast(o_custkey % 3 as varchar(20))) end as varchar(20)) as repo,
  o_orderkey as seq
from {orders}
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels")


def oracle(sql: str, **parts: str) -> str:
    """The SQL with plain table names, for an engine that has them as views."""
    names = {t: t for t in _TABLES}
    return sql.format(**names, **{k: v.format(**names, **parts) for k, v in parts.items()})


def frame(spark: SparkSession, sf_dir: str, sql: str, **parts: str) -> DataFrame:
    """The SQL over the Parquet tables of sf_dir."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    return spark.sql(sql.format(**names, **{k: v.format(**names, **parts) for k, v in parts.items()}))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EDGES)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CALLS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
