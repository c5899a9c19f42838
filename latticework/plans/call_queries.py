"""Registered queries of the matching joins and of network calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import classify, paths, predicates
from latticework.model import EdgeKind
from latticework.operators import calls as C
from latticework.operators import history
from latticework.operators import matching as M
from latticework.plans import bridge
from latticework.plans.registry import query

# ---- facts over the bridge ------------------------------------------------------------------------------------------------------

STUBS = "select concat('repo', cast(s_suppkey % 3 as varchar(9))) as repo, concat('Svc', cast(s_nationkey % 9 as varchar(9))) as service_name, concat('f', cast(s_suppkey as varchar(9)), '.go') as file, cast(s_suppkey as int) as line from {supplier}"
REGS = "select concat('repo', cast(n_regionkey as varchar(9))) as repo, concat('Svc', cast(n_nationkey % 12 as varchar(9))) as service_name, concat('srv', cast(n_nationkey as varchar(9)), '.go') as file, n_nationkey as line from {nation} where n_nationkey % 12 <> 4"
PROTOS = "select distinct concat('Svc', cast(n_nationkey % 6 as varchar(9))) as service_name from {nation}"
HTTP = "select page_id, url, concat('repo', cast(page_id % 3 as varchar(9))) as repo, concat('/', case when page_id % 6 < 3 then 'API/' else 'api//' end, 'v', cast(page_id % 3 as varchar(9)), case when page_id % 5 = 0 then '/' when page_id % 5 = 1 then concat('/Item/', cast(page_id % 21 as varchar(9))) when page_id % 5 = 2 then concat('/item/', cast(page_id % 21 as varchar(9)), '/x/') else '' end, case when page_id % 14 = 7 then '/deep' else '' end) as path, case page_id % 4 when 0 then 'GET' when 1 then 'post' when 2 then '' else 'PUT' end as method, concat('f', cast(page_id as varchar(9))) as file, cast(page_id as int) as line from {pages}"
CLIENTS = f"select repo, path, method, file, line from ({HTTP}) h where page_id % 2 = 1"
ROUTES = f"select repo, path, method, file, line from ({HTTP}) h where page_id % 2 = 0"
VALUE = "concat(case when s_suppkey % 5 = 0 then '' else 'http://' end, lower(replace(s_name, ' ', '-')), case s_suppkey % 4 when 0 then '-staging' when 1 then '-prod' else '' end, case when s_suppkey % 3 = 0 then '' else concat('.ns', cast(s_nationkey as varchar(9)), '.svc.cluster.local') end, case when s_suppkey % 2 = 0 then concat(':', cast(8000 + s_suppkey * 700 as varchar(9))) else '' end, case when s_suppkey % 7 < 3 then '/p/q' else '' end)"
ENV_DEFS = f"select concat('repo', cast(s_suppkey % 3 as varchar(9))) as repo, concat('VAR_', cast(s_suppkey % 40 as varchar(9))) as var_name, {VALUE} as value, 'values.yaml' as file, cast(s_suppkey as int) as line from {{supplier}}"
ENV_READS = "select concat('repo', cast(c_custkey % 3 as varchar(9))) as repo, concat('VAR_', cast(c_custkey % 60 as varchar(9))) as var_name, concat('c', cast(c_custkey % 10 as varchar(9)), '.py') as file, cast(c_custkey as int) as line from {customer}"
BUILT = "select concat('repo', cast(p_partkey % 2 as varchar(9))) as repo, concat('gcr.io/', lower(replace(p_brand, '#', '-')), '/', lower(replace(p_type, ' ', '-')), ':v', cast(p_size as varchar(9))) as image_ref, 'Dockerfile' as file from {part} where p_partkey % 2 = 0"
USED = "select concat('repo', cast(p_partkey % 3 as varchar(9))) as repo, concat(case when p_partkey % 3 = 0 then 'gcr.io' else 'host:5000' end, '/', lower(replace(p_brand, '#', '-')), '/', lower(replace(p_type, ' ', '-')), case when p_partkey % 4 = 0 then '@sha256:0a' when p_partkey % 4 = 1 then ':latest' else '' end) as image_ref, 'k8s.yaml' as file, cast(p_partkey as int) as line from {part} where p_partkey % 2 = 1"
WS = "select page_id, concat('repo', cast(page_id % 3 as varchar(9))) as repo, concat(case page_id % 3 when 0 then '' when 1 then 'ws://api.ns.svc.cluster.local:80' else 'wss://host' end, '/ws/', cast(page_id % 15 as varchar(9)), case when page_id % 4 = 0 then '/in/' else '' end) as url, concat('f', cast(page_id as varchar(9))) as file, cast(page_id as int) as line from {pages}"
WS_CLIENTS = f"select repo, url, file, line from ({WS}) w where page_id % 2 = 1"
WS_SERVERS = f"select repo, url as path, file, line from ({WS}) w where page_id % 2 = 0"


def _frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return bridge.frame(spark, sf_dir, sql)


def _o(sql: str) -> str:
    return bridge.oracle(sql)


# SQL of the kernels, as other engines spell them.
_NORM = "case when regexp_replace(lower(trim({0})), '/+$', '') = '' then '/' else replace(regexp_replace(lower(trim({0})), '/+$', ''), '//', '/') end"
_TRIVIAL = ", ".join(f"'{p}'" for p in paths.TRIVIAL_PATHS)
_SEGS = "len(list_filter(string_split({0}, '/'), lambda x: x <> ''))"


@query(f"with s as ({_o(STUBS)}), r as ({_o(REGS)}), p as ({_o(PROTOS)}) select s.service_name, s.repo as client_repo, s.file as client_file, s.line as client_line, r.repo as server_repo, r.file as server_file, r.line as server_line, p.service_name is not null as known, case when s.repo = r.repo then 0.5 else 0.95 end::double as confidence from s join r using (service_name) left join p on p.service_name = s.service_name")
def proto_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_protos(*(_frame(spark, sf_dir, q) for q in (STUBS, REGS, PROTOS)))
    return found.select("service_name", "client_repo", "client_file", "client_line", "server_repo", "server_file", "server_line", "known", F.col("confidence").cast("double").alias("confidence"))


@query(f"with s as ({_o(STUBS)}), r as ({_o(REGS)}) select * from s where service_name not in (select service_name from r)")
def unresolved_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unresolved_stubs(_frame(spark, sf_dir, STUBS), _frame(spark, sf_dir, REGS)).select("repo", "service_name", "file", "line")


_REST = f"with c as (select *, {_NORM.format('path')} as norm from ({_o(CLIENTS)}) x), s as (select *, {_NORM.format('path')} as norm from ({_o(ROUTES)}) x), cc as (select * from c where norm not in ({_TRIVIAL})), ss as (select * from s where norm not in ({_TRIVIAL}))"
_AGREES = "(c.method = '' or s.method = '' or lower(c.method) = lower(s.method))"


@query(f"{_REST} select s.path as server_path, case when {_AGREES} then s.method else '' end as method, c.file as client_file, s.file as server_file, case when c.repo = s.repo then 0.4 when {_AGREES} then 0.85 else 0.6 end::double as confidence from cc c join ss s using (norm)")
def rest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.rest_exact(_frame(spark, sf_dir, CLIENTS), _frame(spark, sf_dir, ROUTES))
    return found.select("server_path", "method", "client_file", "server_file", F.col("confidence").cast("double").alias("confidence"))


@query(f"{_REST} select s.path as server_path, c.file as client_file, s.file as server_file, case when c.repo = s.repo then 0.3 else 0.6 end::double as confidence from cc c, ss s where c.norm not in (select norm from ss) and least({_SEGS.format('c.norm')}, {_SEGS.format('s.norm')}) >= 2 and (starts_with(c.norm, s.norm) or starts_with(s.norm, c.norm))")
def rest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.rest_prefix(_frame(spark, sf_dir, CLIENTS), _frame(spark, sf_dir, ROUTES))
    return found.select("server_path", "client_file", "server_file", F.col("confidence").cast("double").alias("confidence"))


_IS_DNS = "regexp_matches({0}, '(^|://)[^/.]+\\.[^/.]+(\\.[^/.]+)*\\.svc([.:/]|$)')"


@query(f"with r as ({_o(ENV_READS)}), d as ({_o(ENV_DEFS)}) select r.var_name, r.repo as read_repo, r.line as read_line, d.repo as def_repo, d.line as def_line, case when {_IS_DNS.format('d.value')} then 0.85 else 0.7 end::double as confidence from r join d using (var_name)")
def helm_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_helm_env(_frame(spark, sf_dir, ENV_READS), _frame(spark, sf_dir, ENV_DEFS))
    return found.select("var_name", "read_repo", "read_line", "def_repo", "def_line", F.col("confidence").cast("double").alias("confidence"))


_AUTH = "string_split(regexp_replace({0}, '^.*?://', ''), '/')[1]"
_PORT = f"case when regexp_matches({_AUTH}, ':[0-9]+$') and cast(regexp_extract({_AUTH}, ':([0-9]+)$', 1) as bigint) <= 65535 then cast(regexp_extract({_AUTH}, ':([0-9]+)$', 1) as int) end"


@query(f"with r as ({_o(ENV_READS)}), d as ({_o(ENV_DEFS)}), t as (select *, {_PORT.format('value')} as port, string_split(string_split({_AUTH.format('value')}, '.')[1], ':')[1] as service from d) select r.var_name, r.line as read_line, t.line as bound_line, t.service, case when t.port is not null then 0.95 else 0.8 end::double as confidence from r join t using (var_name)")
def k8s_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = _frame(spark, sf_dir, ENV_DEFS).select("var_name", "value", "file", "line", F.lit("frontend").alias("deployment_name"))
    found = M.match_env_services(_frame(spark, sf_dir, ENV_READS), bindings)
    return found.select("var_name", "read_line", "bound_line", F.col("to.service").alias("service"), F.col("confidence").cast("double").alias("confidence"))


_IMG = "case when contains({0}, '@') then string_split({0}, '@')[1] else regexp_replace({0}, ':[^/:]*$', '') end"


@query(f"with b as (select *, {_IMG.format('image_ref')} as p from ({_o(BUILT)}) x), u as (select *, {_IMG.format('image_ref')} as p from ({_o(USED)}) x) select b.image_ref as built_image_ref, u.image_ref as used_image_ref, b.repo as built_repo, u.line as used_line, case when b.p = u.p then 0.95 else 0.7 end::double as confidence from u join b on (b.p = u.p) or (u.p not in (select p from b) and string_split(b.p, '/')[-1] = string_split(u.p, '/')[-1])")
def image_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_images(_frame(spark, sf_dir, BUILT), _frame(spark, sf_dir, USED))
    return found.select("built_image_ref", "used_image_ref", "built_repo", "used_line", F.col("confidence").cast("double").alias("confidence"))


_WSN = "case when regexp_replace(lower({0}), '/+$', '') = '' then '/' else regexp_replace(lower({0}), '/+$', '') end"
_WSP = "case when starts_with({0}, '/') then {0} else '/' || regexp_replace(regexp_replace({0}, '^.*?://', ''), '^[^/]*/?', '') end"


@query(f"with c as (select *, {_WSN.format(_WSP.format('url'))} as norm from ({_o(WS_CLIENTS)}) x), s as (select *, {_WSN.format(_WSP.format('path'))} as norm from ({_o(WS_SERVERS)}) x) select c.file as client_file, s.file as server_file, c.norm = s.norm as exact, case when c.norm = s.norm then case when c.repo = s.repo then 0.4 when contains(c.url, '.svc.') then 0.85 else 0.75 end when c.repo = s.repo then 0.3 else 0.5 end::double as confidence from c join s on c.norm = s.norm or (c.norm not in (select norm from s) and (starts_with(c.norm, s.norm) or starts_with(s.norm, c.norm)))")
def ws_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_websockets(_frame(spark, sf_dir, WS_CLIENTS), _frame(spark, sf_dir, WS_SERVERS))
    return found.select("client_file", "server_file", "exact", F.col("confidence").cast("double").alias("confidence"))


@query(f"with s as ({_o(STUBS)}), r as ({_o(REGS)}), e as ({_o(ENV_READS)}), d as ({_o(ENV_DEFS)}), x as (select 'grpc' as type from s join r using (service_name) union all select 'helm_env' from e join d using (var_name)) select type, count(*) as n from x group by type union all select 'total', count(*) from x")
def resolver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grpc = M.match_protos(*(_frame(spark, sf_dir, q) for q in (STUBS, REGS, PROTOS)))
    helm = M.match_helm_env(_frame(spark, sf_dir, ENV_READS), _frame(spark, sf_dir, ENV_DEFS)).drop("k8s")
    return M.resolution_counts(M.resolution(grpc=grpc, helm_env=helm))


_EP = "select o_orderkey as id, 4 as kind, case when o_orderkey % 50 = 0 then '/health' else concat('/p/', cast(o_custkey as varchar(9))) end as name, cast(o_orderkey % 4 as int) as repo from {orders}"
_ENV = "select o_orderkey as id, 4 as kind, concat('V', cast(o_custkey as varchar(9))) as name, cast(o_orderkey % 4 as int) as repo from {orders}"


@query(f"with n as ({_o(_EP)}) select a.id as src, b.id as dst from n a join n b on a.name = b.name and a.repo <> b.repo where a.name <> '/health'")
def endpoint_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.same_name_edges(_frame(spark, sf_dir, _EP), 4, EdgeKind.CONNECTS, skip=M.GENERIC_ENDPOINTS).select("src", "dst")


@query(f"with n as ({_o(_ENV)}) select a.id as src, b.id as dst, 200 as confidence from n a join n b on a.name = b.name and a.repo <> b.repo")
def env_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.same_name_edges(_frame(spark, sf_dir, _ENV), 4, EdgeKind.RESOLVES, 200).select("src", "dst", "confidence")


@query("select e.event_id, d.definition from events e left join lateral (select min(s.event_id) as definition from events s where s.user_id = e.user_id and s.event_type = 'signup' and s.ts = (select max(t.ts) from events t where t.user_id = e.user_id and t.event_type = 'signup' and t.ts <= e.ts)) d on true where e.event_type <> 'signup' and d.definition is not null")
def enclosing_symbol_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bridge.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("line"), "event_type")
    defs = events.where("event_type = 'signup'").select("user_id", "line", F.col("event_id").alias("id"))
    found = M.enclosing(events.where("event_type <> 'signup'"), defs, ("user_id",))
    return found.where("definition is not null").select("event_id", "definition")


_SITES = "select cast(o_custkey % 30 as varchar(9)) as file, cast(o_orderkey % 400 as int) as line, o_orderkey as id, cast(o_custkey % 2 as varchar(9)) as repo from {orders}"


@query(f"with d as (select * from ({_o(_SITES)}) x where id % 7 = 0), s as (select * from ({_o(_SITES)}) x where id % 11 = 3), t as (select * from ({_o(_SITES)}) x where id % 11 = 5), m as (select s.repo as r1, s.file as f1, s.line as l1, t.repo as r2, t.file as f2, t.line as l2 from s join t on s.line = t.line and s.repo <> t.repo), g as (select repo, file, line, min(id) as id from d group by repo, file, line) select * from (select (select arg_max(id, line) from g where g.repo = m.r1 and g.file = m.f1 and g.line <= m.l1) as src, (select arg_max(id, line) from g where g.repo = m.r2 and g.file = m.f2 and g.line <= m.l2) as dst, 216 as confidence from m) where src <> dst")
def crossrepo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _frame(spark, sf_dir, _SITES)
    s, t = (M._prefixed(sites.where(f"id % 11 = {k}").drop("id"), p) for k, p in ((3, "client"), (5, "server")))
    matches = s.join(t, (F.col("client_line") == F.col("server_line")) & (F.col("client_repo") != F.col("server_repo"))).withColumn("confidence", F.lit(0.85))
    return M.match_edges(matches, sites.where("id % 7 = 0")).select("src", "dst", F.col("confidence").cast("int").alias("confidence"))


_CALLED = "select o_orderkey as caller, concat('NATION_', cast(o_custkey % 40 as varchar(9))) as name from {orders}"
_NAMED = "select n_nationkey + 100 as id, 3 as kind, n_name as name from {nation}"


@query(f"with c as ({_o(_CALLED)}), n as ({_o(_NAMED)}), f as (select name, min(id) as target from n group by name) select distinct caller as src, cast(target as bigint) as dst from c join f using (name) where caller <> target")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolve_calls(_frame(spark, sf_dir, _CALLED), _frame(spark, sf_dir, _NAMED)).select("src", F.col("dst").cast("long").alias("dst"))


_INDEX = "select case when s_suppkey % 2 = 0 then 'grpc_clients' else 'grpc_servers' end as map_name, concat('Svc', cast(s_nationkey as varchar(9))) as key, cast(1000 + s_suppkey % 3 as int) as repo_id, concat('r', cast(s_suppkey % 3 as varchar(9))) as repo_name, concat('f', cast(s_suppkey as varchar(9))) as file, cast(s_suppkey as int) as line, s_name as symbol from {supplier}"


@query(f"with i as ({_o(_INDEX)}), m as (select a.key, a.repo_id as sr, a.file as sf, b.repo_id as tr, b.file as tf from i a join i b on a.key = b.key and a.repo_id <> b.repo_id where a.map_name = 'grpc_clients' and b.map_name = 'grpc_servers') select distinct key, sr as source_repo_id, sf as source_file, tr as target_repo_id, tf as target_file, 230 as confidence from (select * from m union all select key, tr, tf, sr, sf from m) x")
def overlay_grpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = M.overlay(_frame(spark, sf_dir, _INDEX), "grpc_clients", "grpc_servers", EdgeKind.DEPENDS_ON, 230)
    return edges.select("key", "source_repo_id", "source_file", "target_repo_id", "target_file", "confidence")


@query(f"with i as ({_o(_INDEX)}) select map_name, key, count(*) as n, string_agg(file, ',' order by repo_id, repo_name, file, line, symbol) as files from i group by map_name, key")
def index_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.index_of(_frame(spark, sf_dir, _INDEX)).select("map_name", "key", F.size("entries").cast("long").alias("n"), F.array_join(F.transform("entries", lambda e: e["file"]), ",").alias("files"))


# ---- network calls --------------------------------------------------------------------------------------------------------------

CALLS = _o(bridge.CALLS)
_RANK = "case confidence when 'type_confirmed' then 4 when 'llm_classified' then 3 when 'import_resolved' then 2 when 'heuristic' then 1 else 0 end"
_CALL = "file, line, net_kind, callee_fqn, confidence, seq"


@query(f"select {_CALL} from (select *, row_number() over (partition by file, line order by {_RANK} desc, seq) as k from ({CALLS}) c) x where k = 1")
def calls_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup(bridge.calls(spark, sf_dir)).select(*_CALL.split(", "))


@query(f"with c as ({CALLS}) select {_CALL} from (select *, row_number() over (partition by file, line order by case when seq % 3 = 0 then 0 else 1 end, seq) as k from c where seq % 3 < 2) x where k = 1")
def calls_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bridge.calls(spark, sf_dir)
    return C.first_wins(calls.where("seq % 3 = 0"), calls.where("seq % 3 = 1")).select(*_CALL.split(", "))


_NOISE = " or ".join([f"contains(lower(file), '{x}')" for x in predicates.NOISE_PARTS] + [f"ends_with(lower(file), '{x}')" for x in predicates.NOISE_ENDS] + [f"starts_with(lower(file), '{x}')" for x in predicates.NOISE_STARTS])


@query(f"select {_CALL} from ({CALLS}) c where not ({_NOISE})")
def noise_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_noise(bridge.calls(spark, sf_dir)).select(*_CALL.split(", "))


_A, _B = f"(select * from ({CALLS}) c where seq % 5 <> 0)", f"(select file, line, callee_fqn, case when seq % 17 = 0 then 'redis' else net_kind end as net_kind, address_source, seq from ({CALLS}) c where seq % 7 <> 0)"
_LAST = "select file, line, callee_fqn, arg_max(struct_pack(net_kind := net_kind, address_source := address_source), seq) as v from {0} x group by all"
_DIFF = f"with a as ({_LAST.format(_A)}), b as ({_LAST.format(_B)}), d as (select concat_ws(':', file, cast(line as varchar), callee_fqn) as key, case when a.v is null then 'added' when b.v is null then 'removed' when a.v <> b.v then 'changed' end as change, a.v.net_kind as kind_before, b.v.net_kind as kind_after from a full join b using (file, line, callee_fqn))"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = bridge.calls(spark, sf_dir).select("file", "line", "callee_fqn", "net_kind", "address_source", "seq")
    return calls.where("seq % 5 <> 0"), calls.where("seq % 7 <> 0").withColumn("net_kind", F.when(F.col("seq") % 17 == 0, "redis").otherwise(F.col("net_kind")))


@query(f"{_DIFF} select * from d where change is not null")
def network_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diff(*_snapshots(spark, sf_dir)).select("key", "change", F.col("before.net_kind").alias("kind_before"), F.col("after.net_kind").alias("kind_after"))


@query(f"{_DIFF} select change, count(*) as n from d where change is not null group by change")
def network_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diff_counts(C.diff(*_snapshots(spark, sf_dir)))


@query(f"with a as (select distinct file, line, callee_fqn from {_A} x), b as (select distinct file, line, callee_fqn from {_B} x) select *, 'removed' as change from (select * from a except select * from b) union all select *, 'added' from (select * from b except select * from a)")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.key_diff(*_snapshots(spark, sf_dir))


@query(f"with e as ({_o(bridge.EDGES)}), a as (select src, dst, kind from e where (src + dst) % 10 <> 0), b as (select src, dst, kind from e where (src + dst) % 11 <> 0) select *, 'removed' as change from (select * from a except select * from b) union all select *, 'added' from (select * from b except select * from a)")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = bridge.edges(spark, sf_dir)
    return C.graph_diff(edges.where("(src + dst) % 10 <> 0"), edges.where("(src + dst) % 11 <> 0"), ["src", "dst", "kind"])


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 10 not in (3, 4) union all select o_orderkey, o_custkey, cast(0 as double) from orders where o_orderkey % 10 = 4")
def delta_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bridge.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return C.layered(base, base.where("o_orderkey % 10 = 3"), base.where("o_orderkey % 10 = 4").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


_LABEL = "case net_kind " + " ".join(f"when '{k}' then '{v}'" for k, v in classify.KIND_LABELS.items()) + " else net_kind end"
_DIRECTION = f"case when net_kind in ({', '.join(map(repr, classify.INBOUND_KINDS))}) then 'inbound' when net_kind in ({', '.join(map(repr, classify.OUTBOUND_KINDS))}) then 'outbound' else 'unknown' end"


@query(f"select {_LABEL} as kind, {_DIRECTION} as direction, count(*) as n from ({CALLS}) c group by 1, 2")
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary(bridge.calls(spark, sf_dir))


@query(f"select {_CALL} from ({CALLS}) c where starts_with(net_kind, 'http') or contains(net_kind, 'http')")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.calls(spark, sf_dir).where(classify.kind_matches(F.col("net_kind"), "HTTP")).select(*_CALL.split(", "))


@query(f"with c as (select *, nullif(regexp_extract(address_source, '\"var_name\":\"([^\"]*)\"', 1), '') as env_var from ({CALLS}) x) select seq, env_var from c where repo is not null and env_var in (select env_var from c where repo is null)")
def remote_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bridge.calls(spark, sf_dir).withColumn("env_var", F.get_json_object("address_source", "$.EnvVar.var_name"))
    return C.remote_kept(calls.where("repo is not null"), calls.where("repo is null")).select("seq", "env_var")


@query(f"select {_CALL} from ({CALLS}) c where contains(callee_fqn, 'Fn7') or contains(file, 'Fn7') or contains(address_source, 'Fn7')")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explain(bridge.calls(spark, sf_dir), "Fn7").select(*_CALL.split(", "))


@query(f"select count(*) as total, count(*) filter (confidence <> 'heuristic') as resolved, count(*) filter (confidence = 'heuristic') as heuristic, count(*) filter (starts_with(address_source, '{{\"Dynamic\"')) as dynamic from ({CALLS}) c")
def fix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fix_summary(bridge.calls(spark, sf_dir))


@query(f"select callee_fqn, (arg_min(struct_pack(f := file, l := line), struct_pack(f := file, l := line))).f as file, (arg_min(struct_pack(f := file, l := line), struct_pack(f := file, l := line))).l as line, count(*) as n from ({CALLS}) c where confidence = 'heuristic' group by callee_fqn")
def callee_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.callee_templates(bridge.calls(spark, sf_dir))


_PLACED = "select s_suppkey as id, s_name as name, concat('src/s', cast(s_suppkey % 40 as varchar(9)), '.go') as file, cast(s_suppkey % 50 as int) as line from {supplier} union all select 1000000 + p_partkey, p_name, null, null from {part}"
_CONNECTS = "select distinct l_suppkey as src, 1000000 + l_partkey as dst from {lineitem} "
_WORDS = " ".join(f"when {' or '.join(f'contains(lower(target), {w!r})' for w in words)} then '{kind}'" for kind, words in classify.RESOURCE_WORDS)


@query(f"with p as ({_o(_PLACED)}), e as ({_o(_CONNECTS)}), k as (select file, line, arg_max(net_kind, seq) as net_kind, arg_max(confidence, seq) as confidence from ({CALLS}) c group by file, line), r as (select a.file, a.line, a.name as symbol, b.name as target, k.net_kind as k, k.confidence as c from e join p a on a.id = e.src join p b on b.id = e.dst left join k on k.file = a.file and k.line = a.line), s as (select *, coalesce(k, case {_WORDS} else 'unknown' end) as net_kind from r) select file, line, symbol, target, net_kind as kind, {_DIRECTION} as direction, coalesce(c, 'graph') as confidence from s")
def network_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.connects_report(_frame(spark, sf_dir, _CONNECTS), _frame(spark, sf_dir, _PLACED), bridge.calls(spark, sf_dir))


@query(f"select {_CALL} from ({CALLS}) c where not exists (select 1 from ({_o(_PLACED)}) p where p.file = c.file and p.line = c.line)")
def taint_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.taint_only(bridge.calls(spark, sf_dir), _frame(spark, sf_dir, _PLACED)).select(*_CALL.split(", "))


_OUT = "select concat('o', cast(s_suppkey as varchar(9)), '.go') as file, cast(s_suppkey as int) as line, case s_suppkey % 3 when 0 then concat('pb.NewSvc', cast(s_nationkey as varchar(9)), 'Client') else concat('call/v1/item', cast(s_suppkey % 4 as varchar(9))) end as callee, case s_suppkey % 4 when 0 then '' when 1 then concat('http://h/v1/item', cast(s_suppkey % 6 as varchar(9)), '/x') when 2 then concat('http://billing', cast(s_suppkey % 5 as varchar(9)), '.ns.svc.cluster.local:80/z') else concat('grpc:K', cast(s_suppkey % 5 as varchar(9))) end as address_hint, cast(case when s_suppkey % 5 = 0 then null else concat('r', cast(s_suppkey % 2 as varchar(9))) end as varchar(9)) as repo from {supplier}"
_ENDS = "select concat('e', cast(n_nationkey as varchar(9)), '.go') as file, n_nationkey as line, case n_nationkey % 4 when 0 then '/v1/item1' when 1 then '/' when 2 then concat('grpc:k', cast(n_nationkey % 5 as varchar(9))) else concat('/v1/item', cast(n_nationkey % 6 as varchar(9))) end as path, case n_nationkey % 3 when 0 then concat('RegisterSvc', cast(n_nationkey as varchar(9)), 'Server') when 1 then concat('Billing', cast(n_nationkey % 5 as varchar(9))) else 'main' end as service, concat('r', cast(n_nationkey % 3 as varchar(9))) as repo from {nation}"
_BARE = "string_split(string_split(string_split(string_split(string_split(lower(address_hint), '://')[-1], ':')[1], '/')[1], '.svc.cluster.local')[1], '.')[1]"


@query(f"with o as ({_o(_OUT)}), e as ({_o(_ENDS)}), p as (select o.file, o.line, o.callee, e.file as e_file, e.line as e_line, e.path as e_path, case when starts_with(e.path, '/') and len(e.path) >= 3 and (contains(address_hint, e.path) or contains(callee, e.path)) then 'path' when nullif(regexp_extract(callee, 'New(.+)Client$', 1), '') = regexp_extract(e.service, '^Register(.+)Server$', 1) then 'grpc' when starts_with(address_hint, 'grpc:') and lower(address_hint) = lower(e.path) then 'grpc' when address_hint <> '' and e.service <> 'main' and e.path <> '/' and ((contains(lower(address_hint), '.svc.cluster.local') and contains(lower(e.service), {_BARE})) or (len(e.service) > 6 and contains(lower(address_hint), lower(e.service)))) then 'url' end as match_type from o, e where o.repo is distinct from e.repo) select distinct * from p where match_type is not null")
def outbound_endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.outbound_matches(_frame(spark, sf_dir, _OUT), _frame(spark, sf_dir, _ENDS))
    return found.select("file", "line", "callee", "e_file", "e_line", "e_path", "match_type")


# ---- snapshots ------------------------------------------------------------------------------------------------------------------

_SNAPS = "select k as snapshot, concat('f', cast(o_orderkey as varchar(9))) as name from {orders} cross join (values (0), (1), (2), (3)) t(k) where (o_custkey + k * 7) % 5 <> 0"


@query(f"with s as ({_o(_SNAPS)}) select snapshot, change, count(*) as n from (select snapshot, name, 'added' as change from s a where not exists (select 1 from s b where b.name = a.name and b.snapshot = a.snapshot - 1) union all select snapshot + 1, name, 'removed' from s a where snapshot < 3 and not exists (select 1 from s b where b.name = a.name and b.snapshot = a.snapshot + 1)) x group by snapshot, change")
def history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.log_counts(history.log(_frame(spark, sf_dir, _SNAPS), ["name"]))


@query(f"with s as ({_o(_SNAPS)}) select name, max(snapshot) as since from s a where not exists (select 1 from s b where b.name = a.name and b.snapshot = a.snapshot - 1) and name in (select name from s where snapshot = 3) group by name")
def history_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.blame(_frame(spark, sf_dir, _SNAPS), ["name"])
