"""Registered queries of the kernels, of searches and of provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import classify, paths, predicates
from latticework.operators import provenance, search
from latticework.plans import bridge
from latticework.plans.call_queries import _IMG, _NORM, _WSN, _WSP, BUILT, CALLS, ENV_DEFS, HTTP, USED, WS, _o
from latticework.plans.registry import query
from latticework.sources.lines import context


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return bridge.frame(spark, sf_dir, sql)


def _has(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


# ---- addresses ------------------------------------------------------------------------------------------------------------------

_AFTER = "regexp_replace(value, '^.*?://', '')"
_AUTH = f"string_split({_AFTER}, '/')[1]"
_PORT = f"case when regexp_matches({_AUTH}, ':[0-9]+$') and cast(regexp_extract({_AUTH}, ':([0-9]+)$', 1) as bigint) <= 65535 then cast(regexp_extract({_AUTH}, ':([0-9]+)$', 1) as int) end"
_HOST = f"case when {_PORT} is not null then regexp_replace({_AUTH}, ':[0-9]+$', '') else {_AUTH} end"


@query(f"with d as ({_o(ENV_DEFS)}), h as (select *, {_HOST} as host, {_PORT} as port, case when contains({_AFTER}, '/') then regexp_extract({_AFTER}, '(/.*)$', 1) else '/' end as path from d) select line, regexp_replace(string_split(host, '.')[1], '({'|'.join(paths.ENV_SUFFIXES)})$', '') as service, string_split(host, '.')[2] as namespace, host, coalesce(port, -1) as port, path from h where list_position(string_split(host, '.'), 'svc') >= 3")
def k8s_dns_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _of(spark, sf_dir, ENV_DEFS).select("line", paths.k8s_dns(F.col("value")).alias("k")).where("k is not null")
    return found.select("line", "k.service", "k.namespace", "k.host", F.coalesce("k.port", F.lit(-1)).alias("port"), "k.path")


@query(f"with d as ({_o(ENV_DEFS)}) select line, string_split(string_split({_AUTH}, '.')[1], ':')[1] as service, coalesce({_PORT}, -1) as port from d")
def service_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _of(spark, sf_dir, ENV_DEFS).select("line", paths.service_value(F.col("value")).alias("v")).where("v is not null")
    return found.select("line", "v.service", F.coalesce("v.port", F.lit(-1)).alias("port"))


@query(f"select page_id, {_NORM.format('path')} as norm, len(list_filter(string_split({_NORM.format('path')}, '/'), lambda x: x <> '')) as segments from ({_o(HTTP)}) h")
def rest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = paths.rest_path(F.col("path"))
    return _of(spark, sf_dir, HTTP).select("page_id", norm.alias("norm"), paths.segments(norm).cast("long").alias("segments"))


@query(f"select page_id, {_WSP.format('url')} as path, {_WSN.format(_WSP.format('url'))} as norm from ({_o(WS)}) w")
def ws_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = paths.ws_path(F.col("url"))
    return _of(spark, sf_dir, WS).select("page_id", path.alias("path"), paths.ws_norm(path).alias("norm"))


@query(f"select image_ref, {_IMG.format('image_ref')} as path, string_split({_IMG.format('image_ref')}, '/')[-1] as name from (select image_ref from ({_o(BUILT)}) b union select image_ref from ({_o(USED)}) u) x")
def image_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _of(spark, sf_dir, BUILT).select("image_ref").union(_of(spark, sf_dir, USED).select("image_ref")).distinct()
    return refs.select("image_ref", paths.image_path(F.col("image_ref")).alias("path"), paths.image_name(F.col("image_ref")).alias("name"))


# ---- names ----------------------------------------------------------------------------------------------------------------------

NAMES = "select c_custkey as id, case c_custkey % 6 when 0 then upper(replace(c_name, '#', '_')) when 1 then replace(c_name, '#', '.') when 2 then concat(upper(c_mktsegment), '_URL') when 3 then concat('svc_', lower(c_mktsegment), 'Ab') when 4 then concat('DB_DSN', cast(c_custkey as varchar(9))) else concat(c_mktsegment, ' x') end as name from {customer}"
_LETTERS, _CAPITALS = "len(regexp_replace(name, '[^A-Za-z]', '', 'g'))", "len(regexp_replace(name, '[^A-Z]', '', 'g'))"


@query(f"with n as ({_o(NAMES)}) select id, regexp_full_match(name, '[A-Z0-9_]+') as strict, len(name) >= 2 and {_LETTERS} > 0 and ({_CAPITALS} * 100) // greatest({_LETTERS}, 1) >= 60 and regexp_full_match(name, '[A-Za-z0-9_.]*') as loose, {_has('upper(name)', predicates.ADDRESS_NAMES)} or ends_with(upper(name), '_DSN') as address from n")
def env_var_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return _of(spark, sf_dir, NAMES).select("id", predicates.env_name_strict(n).alias("strict"), predicates.env_name_loose(n).alias("loose"), predicates.address_variable(n).alias("address"))


_HP = "(contains(v, ':') and regexp_matches(v, '[A-Za-z][^:]*:[0-9]+(/[^:]*)?$') and not contains(regexp_extract(v, '^(.*):', 1), '//'))"


@query(f"with d as (select line, lower(value) as v from ({_o(ENV_DEFS)}) x) select line, {' or '.join(f'''starts_with(v, '{s}://')''' for s in predicates.SCHEMES)} or contains(v, '.svc.cluster.local') or {_HP} as network, case when {_has('v', ['redis', ':6379'])} then 'redis' when {_has('v', ['kafka', ':9092'])} then 'kafka_producer' when {_has('v', ['postgres', 'mysql', ':5432', ':3306'])} then 'database' else 'http_client' end as kind from d")
def category_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _of(spark, sf_dir, ENV_DEFS).select("line", predicates.network_value(v).alias("network"), classify.address_kind(v).alias("kind"))


KINDS = "select p_partkey as id, concat(case p_partkey % 11 when 0 then 'OrderGrpc' when 1 then 'restThing' when 2 then 'RedisCache' when 3 then 'my-queue' when 4 then 'UserDB' when 5 then 'wsHub' when 6 then 'sqsX' when 7 then 'S3Bucket' when 8 then 'TcpSock' when 9 then 'RegisterFooServer' else 'plain' end, '_', cast(p_partkey as varchar(9))) as name from {part}"
_RES = " ".join(f"when {_has('lower(name)', words)} then '{kind}'" for kind, words in classify.RESOURCE_WORDS)


@query(f"with n as ({_o(KINDS)}) select id, case {_RES} else 'unknown' end as resource, case when {_has('lower(name)', ['grpc', 'proto'])} then 'grpc_server' when contains(lower(name), 'ws') then 'websocket_server' else 'http' end as endpoint from n")
def infer_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, KINDS).select("id", classify.resource_kind(F.col("name")).alias("resource"), classify.endpoint_kind(F.col("name")).alias("endpoint"))


ENDPOINTS = "select page_id, concat(case page_id % 4 when 0 then 'GET ' when 1 then 'POST' when 2 then '' else 'FETCH ' end, case when page_id % 5 = 0 then 'x' else '' end, '/v', cast(page_id as varchar(9))) as name from {pages}"


@query(f"with n as ({_o(ENDPOINTS)}) select page_id, coalesce(nullif(regexp_extract(name, '^(GET|POST)\\s*/', 1), ''), '-') as method, case when regexp_matches(name, '^(GET|POST)\\s*/') then regexp_extract(name, '(/.*)$', 1) else name end as path from n")
def endpoint_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = classify.endpoint_parts(F.col("name"))
    return _of(spark, sf_dir, ENDPOINTS).select("page_id", F.coalesce(parts["method"], F.lit("-")).alias("method"), parts["path"].alias("path"))


SYMBOLS = "select s_suppkey as id, case s_suppkey % 7 when 0 then concat('New', cast(s_nationkey as varchar(9)), 'Client') when 1 then concat('RegisterS', cast(s_nationkey as varchar(9)), 'Server') when 2 then concat('pb.v', cast(s_nationkey as varchar(9)), '.NewAClient') when 3 then concat('add_B', cast(s_nationkey as varchar(9)), 'Servicer_to_server') when 4 then concat('pb2.C', cast(s_nationkey as varchar(9)), 'Stub') when 5 then 'NewClient' else 'Other.fn' end as name from {supplier}"
_SHORT = "string_split(name, '.')[-1]"


@query(f"with n as ({_o(SYMBOLS)}) select id, coalesce(nullif(regexp_extract({_SHORT}, '^New(.+)Client$', 1), ''), nullif(regexp_extract({_SHORT}, '^Register(.+)Server$', 1), ''), nullif(regexp_extract({_SHORT}, '^add_(.+)Servicer_to_server$', 1), ''), nullif(regexp_extract({_SHORT}, '^(.+)Stub$', 1), ''), '-') as service from n")
def grpc_service_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, SYMBOLS).select("id", F.coalesce(classify.grpc_service(F.col("name")), F.lit("-")).alias("service"))


RAW = "select o_orderkey as id, case o_orderkey % 13 when 0 then 'grpc' when 1 then 'http' when 2 then 'axios' when 3 then 'server' when 4 then 'wsConn' when 5 then 'kafkaProducer' when 6 then 'db' when 7 then 'redis' when 8 then 'sqs' when 9 then 's3' when 10 then 'net' when 11 then '' else 'thing' end as recv, case o_custkey % 12 when 0 then 'Dial' when 1 then 'Get' when 2 then 'ListenAndServe' when 3 then 'connect' when 4 then 'publish' when 5 then 'Subscribe' when 6 then 'NewClient' when 7 then 'sendMessage' when 8 then 'upload' when 9 then 'handleFunc' when 10 then 'Register' else 'foo' end as meth, case o_orderkey % 5 when 0 then 'http://x' when 1 then ':8080' when 2 then '' when 3 then '/p' else 'host:99' end as arg from {orders}"


def _rule_sql(rule: dict) -> str:
    tests, recv = [], []
    recv += [f"contains(r, '{w}')" for w in rule.get("r_has", ())] + [f"ends_with(r, '{w}')" for w in rule.get("r_ends", ())] + [f"r = '{w}'" for w in rule.get("r_is", ())]
    tests += [f"({' or '.join(recv)})"] if recv else []
    tests += [f"not {_has('r', rule['r_lacks'])}"] if "r_lacks" in rule else []
    tests += ["m in (" + ", ".join(f"'{w}'" for w in rule["m_is"]) + ")"] if "m_is" in rule else []
    tests += [_has("m", rule["m_has"])] if "m_has" in rule else []
    for key, call in (("m_starts", "starts_with(m, '{}')"), ("m_ends", "ends_with(m, '{}')"), ("a_starts", "starts_with(a, '{}')")):
        tests += ["(" + " or ".join(call.format(w) for w in rule[key]) + ")"] if key in rule else []
    tests += ["(" + " or ".join("a = ''" if w == "" else f"contains(a, '{w}')" for w in rule["a_has"]) + ")"] if "a_has" in rule else []
    return " and ".join(tests)


_CASES = " ".join(f"when {_rule_sql(rule)} then '{kind}'" for kind, rule in classify.CALL_RULES)


@query(f"with c as (select id, lower(recv) as r, lower(meth) as m, lower(arg) as a from ({_o(RAW)}) x) select id, coalesce(case {_CASES} end, '-') as kind from c")
def heuristic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = classify.call_kind(F.col("recv"), F.col("meth"), F.col("arg"))
    return _of(spark, sf_dir, RAW).select("id", F.coalesce(kind, F.lit("-")).alias("kind"))


_LONG = [w for w in classify.IMPORT_WORDS if len(w) >= 3]


@query(f"with c as (select id, lower(recv) as r, lower(meth) as m, lower(arg) as a from ({_o(RAW)}) x) select id, contains(a, '://') or regexp_matches(a, '^.+:[0-9]+$') or contains(a, 'localhost') or {_has('r', _LONG)} or r in ('ws', 's3', 'db', 'mq') or m in ({', '.join(map(repr, classify.LIFECYCLE))}) or regexp_matches(m, '^(new|create).*({'|'.join(classify.BUILT)})') or regexp_matches(m, '^register.*({'|'.join(classify.REGISTERED)})') as maybe from c")
def permissive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    maybe = classify.may_be_network(F.col("recv"), F.col("meth"), F.col("arg"), F.array().cast("array<string>"))
    return _of(spark, sf_dir, RAW).select("id", maybe.alias("maybe"))


@query("select c_custkey, regexp_full_match(c_name, 'Customer#.*1.*') as one, regexp_full_match(c_name, '.*5') and position('5' in c_name) = len(c_name) as two, c_name = 'Customer#000000003' as three from customer")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    customers = bridge.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", predicates.glob(n, "Customer#*1*").alias("one"), predicates.glob(n, "*5").alias("two"), predicates.glob(n, "Customer#000000003").alias("three"))


TEMPLATES = "select p_partkey as id, case p_partkey % 6 when 0 then concat('{{{{ .Values.h', cast(p_partkey as varchar(9)), ' }}}}') when 1 then concat('{{{{ .Values.x | default \"d', cast(p_partkey as varchar(9)), '\" }}}}') when 2 then 'http://{{{{ .Values.host }}}}:80/{{{{ .p }}}}' when 3 then concat('plain', cast(p_partkey as varchar(9))) when 4 then '{{{{ .a | default 8080 }}}}' else 'open {{{{ .x' end as raw from {part}"


@query(f"with t as ({_o(TEMPLATES)}) select id, regexp_replace(raw, '\\{{\\{{.*?\\}}\\}}', '{{template}}', 'g') as replaced, case when contains(raw, 'default \"') then regexp_extract(raw, 'default \"([^\"]*)\"', 1) when contains(raw, 'default ') then regexp_extract(raw, 'default ([^ }}]*)', 1) when starts_with(raw, '{{{{') and ends_with(raw, '}}}}') then trim(regexp_extract(raw, '^\\{{\\{{(.*)\\}}\\}}$', 1)) else raw end as value from t")
def gotmpl_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _of(spark, sf_dir, TEMPLATES).select("id", predicates.without_templates(raw).alias("replaced"), predicates.template_value(raw).alias("value"))


# ---- searches -------------------------------------------------------------------------------------------------------------------

_QUERY = "Blue widg"
_GRAMS = [_QUERY.lower()[k : k + 3] for k in range(len(_QUERY) - 2)]
_GRAM_SQL = f"len(list_distinct(list_filter(list_transform(range(1, greatest(len(name) - 1, 1)), lambda k: substr(lower(name), k, 3)), lambda g: g in ({', '.join(map(repr, _GRAMS))}))))"


@query(f"with n as (select p_partkey as id, p_name as name from part), h as (select *, {_GRAM_SQL} as hits from n) select id, name, case when lower(name) = '{_QUERY.lower()}' then 3 when starts_with(lower(name), '{_QUERY.lower()}') then 2 else 1 end as quality, hits from h where hits >= {max(1, len(_GRAMS) // 4)} order by quality desc, hits desc, len(name), name, id limit 20")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.trigram_search(names, _QUERY)


@query("select c_custkey as id, c_name as name from customer where contains(lower(c_name), 'r#00000012') order by c_custkey limit 5")
def fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggestions(bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "R#00000012")


@query("select a.conv_id, a.turn, count(*) as n, min(b.turn) as first_turn, max(b.turn) as last_turn from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn - 15 and a.turn + 14 group by a.conv_id, a.turn")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bridge.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = context(turns.select("conv_id", F.col("turn").alias("line"), "text"), turns.select("conv_id", F.col("turn").alias("line")).distinct(), ("conv_id",))
    return found.select("conv_id", F.col("line").alias("turn"), F.size("lines").cast("long").alias("n"), F.col("lines")[0]["line"].alias("first_turn"), F.element_at("lines", -1)["line"].alias("last_turn"))


# ---- provenance -----------------------------------------------------------------------------------------------------------------


@query(f"with c as ({CALLS}) select seq, 0 as depth, case when starts_with(address_source, '{{\"EnvVar\"') then 'EnvVar' when starts_with(address_source, '{{\"Literal\"') then 'Literal' else 'Dynamic' end as kind, case when starts_with(address_source, '{{\"EnvVar\"') then regexp_extract(address_source, '\"var_name\":\"([^\"]*)\"', 1) when starts_with(address_source, '{{\"Literal\"') then 'http://a' else '' end as text from c")
def provenance_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = bridge.calls(spark, sf_dir).select("seq", F.explode(provenance.flattened("address_source")).alias("n"))
    return flat.select("seq", "n.depth", "n.kind", "n.text")


@query(f"with c as ({CALLS}) select seq, case when starts_with(address_source, '{{\"EnvVar\"') then 'EnvVar(' || regexp_extract(address_source, '\"var_name\":\"([^\"]*)\"', 1) || ')' when starts_with(address_source, '{{\"Literal\"') then 'Literal(http://a)' else 'Dynamic' end as chain from c")
def provenance_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.calls(spark, sf_dir).select("seq", provenance.formatted("address_source").alias("chain"))


#: An assignment for each order, in files by customer: most hand a variable on, others end in a literal, the environment, a call or a parameter.
_ASSIGNED = "select concat('f', cast(o_custkey % 700 as varchar(9))) as file, cast(o_orderkey as int) as line, concat('v', cast(o_orderkey % 5 as varchar(9))) as name, case o_orderkey % 23 when 0 then 'literal' when 1 then 'env' when 2 then 'call' when 3 then 'parameter' else 'variable' end as kind, concat('v', cast((o_orderkey + o_custkey) % 6 as varchar(9))) as value from {orders}"


@query(
    f"""with recursive a as (select *, row_number() over () as id from ({_o(_ASSIGNED)}) x),
    u as (select o_orderkey as use, concat('f', o_custkey % 700) as file, concat('v', o_orderkey % 4) as name, cast(o_orderkey as int) - 1 as pos from orders),
    v as (select id, file, value as name, line - 1 as pos from a where kind = 'variable'),
    f as materialized (select use, a.id, u.name from u asof left join a on u.file = a.file and u.name = a.name and u.pos >= a.line),
    n as materialized (select v.id, a.id as next, v.name from v asof left join a on v.file = a.file and v.name = a.name and v.pos >= a.line),
    w(use, depth, id, name) as (select use, 0, id, name from f union all select use, depth + 1, n.next, n.name from w join n on n.id = w.id where depth < 10),
    s as (select use, depth, w.name, a.kind, a.value from w left join a on a.id = w.id)
    select use, depth, coalesce(kind, 'unknown') as kind, coalesce(value, name) as value from s where kind is distinct from 'variable'
    union all select use, depth, 'dynamic', 'depth-exceeded' from s where kind = 'variable' and depth = 10"""
)
def trace_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _of(spark, sf_dir, _ASSIGNED).withColumnRenamed("line", "at")
    orders = bridge.table(spark, sf_dir, "orders")
    uses = orders.select(F.col("o_orderkey").alias("use"), F.expr("concat('f', o_custkey % 700)").alias("file"), F.col("o_orderkey").cast("int").alias("at"), F.expr("concat('v', o_orderkey % 4)").alias("name"))
    return provenance.trace_back(uses, made).select("use", "depth", "kind", "value")


@query(f"with c as ({CALLS}) select seq, case when starts_with(address_source, '{{\"EnvVar\"') then 'env:' || regexp_extract(address_source, '\"var_name\":\"([^\"]*)\"', 1) when starts_with(address_source, '{{\"Literal\"') then 'http://a' else '' end as hint from c")
def address_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.calls(spark, sf_dir).select("seq", paths.address_hint(F.col("address_source")).alias("hint"))


@query("select page_id, coalesce(nullif(nullif(regexp_extract(url, '^.*?://[^/]*(/.*)$', 1), ''), '/'), '-') as path from pages")
def url_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.table(spark, sf_dir, "pages").select("page_id", F.coalesce(paths.url_path(F.col("url")), F.lit("-")).alias("path"))
