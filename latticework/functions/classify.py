"""Kernels that tell what a call, a name or an address is, as column expressions over plain rule tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests) if tests else F.lit(False)


def has_any(text: Column, *words: str) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def first_that(default: str | None, *cases: tuple[Column, str]) -> Column:
    """The label of the first test that holds."""
    out = None
    for test, label in cases:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(default))


# ---- kinds from names and addresses ---------------------------------------------------------------------------------------------

# What a resource's lower-cased name has, in the order of precedence, and the kind that this means.
RESOURCE_WORDS = (
    ("grpc_client", ("grpc", "proto")),
    ("http_client", ("http", "rest", "api")),
    ("redis", ("redis",)),
    ("kafka_producer", ("kafka", "queue", "mq")),
    ("database", ("postgres", "mysql", "sql", "database", "mongo", "db")),
    ("websocket_client", ("websocket", "ws://")),
    ("sqs", ("sqs",)),
    ("s3", ("s3", "bucket")),
    ("tcp_dial", ("tcp", "socket")),
)
# The same for lower-cased addresses; what starts an address stands before what it has.
ADDRESS_STARTS = (("websocket_client", ("ws://", "wss://")), ("grpc_client", ("grpc://", "grpcs://")))
ADDRESS_WORDS = (
    ("redis", ("redis", ":6379")),
    ("kafka_producer", ("kafka", ":9092")),
    ("database", ("postgres", "mysql", ":5432", ":3306")),
)
# Labels of kinds in reports.
KIND_LABELS = {
    "http_client": "HTTP client",
    "http_server": "HTTP server",
    "http": "HTTP",
    "grpc_client": "gRPC client",
    "grpc_server": "gRPC server",
    "websocket_client": "WebSocket client",
    "websocket_server": "WebSocket server",
    "kafka_producer": "Kafka producer",
    "kafka_consumer": "Kafka consumer",
    "database": "Database",
    "redis": "Redis",
    "sqs": "SQS",
    "s3": "S3",
    "tcp_dial": "TCP dial",
    "tcp_listen": "TCP listen",
}
# The kinds that take calls; the other known ones make them.
INBOUND_KINDS = ("http_server", "grpc_server", "websocket_server", "kafka_consumer", "tcp_listen")
OUTBOUND_KINDS = ("http_client", "grpc_client", "websocket_client", "kafka_producer", "database", "redis", "sqs", "s3", "tcp_dial")


def resource_kind(name: Column) -> Column:
    low = F.lower(name)
    return first_that("unknown", *((has_any(low, *words), kind) for kind, words in RESOURCE_WORDS))


def endpoint_kind(name: Column) -> Column:
    low = F.lower(name)
    registers = (name.startswith("Register") & name.endswith("Server")) | (name.startswith("add_") & name.endswith("_to_server"))
    return first_that("http", (has_any(low, "grpc", "proto") | registers, "grpc_server"), (has_any(low, "ws"), "websocket_server"), (has_any(low, "websocket"), "websocket_server"))


def address_kind(value: Column) -> Column:
    low = F.lower(value)
    starts = [(any_of([low.startswith(w) for w in words]), kind) for kind, words in ADDRESS_STARTS]
    return first_that("http_client", *starts, *((has_any(low, *words), kind) for kind, words in ADDRESS_WORDS))


def direction(kind: Column) -> Column:
    return F.when(kind.isin(*INBOUND_KINDS), "inbound").when(kind.isin(*OUTBOUND_KINDS), "outbound").otherwise("unknown")


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_LABELS.items() for x in kv)), kind), kind)


def kind_matches(kind: Column, wanted: str) -> Column:
    """Whether a kind is what was asked for: equal, a beginning of it, or of a family that is named."""
    low, asked = F.lower(kind), wanted.lower()
    family = F.contains(low, F.lit(asked)) if asked in ("grpc", "http", "websocket", "kafka") else F.lit(False)
    return low.startswith(asked) | family


def endpoint_parts(name: Column) -> Column:
    """(method, path) of an endpoint's name: a verb before a path is its method."""
    found = F.regexp_extract(F.trim(name), r"(?s)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*(/.*)$", 1)
    path = F.when(found != "", F.regexp_extract(F.trim(name), r"(?s)^[A-Z]+\s*(/.*)$", 1)).otherwise(F.trim(name))
    return F.struct(F.nullif(found, F.lit("")).alias("method"), path.alias("path"))


def grpc_service(symbol: Column) -> Column:
    """The service that a generated gRPC name belongs to, null if it is none.

    Go's constructors and registrations are told on the whole name, and again on what follows its last dot; there Python's too.
    """
    last = F.substring_index(symbol, ".", -1)
    go = r"(?s)^(?:New(.+)Client|Register(.+)Server)$"
    python = r"(?s)^(?:add_(.+)Servicer_to_server|(.+)Stub)$"

    def got(text: Column, pattern: str) -> Column:
        return F.nullif(F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)), F.lit(""))

    return F.coalesce(got(symbol, go), got(last, go), got(last, python))


# ---- calls ----------------------------------------------------------------------------------------------------------------------

# A call's kind by what its lower-cased receiver, method and first argument are. Of the rows the first that holds counts.
# A field's alternatives hold one by one, and all fields of a row must hold: r_has, r_ends, r_is of the receiver; m_is, m_has, m_starts,
# m_ends of the method; a_starts, a_has of the argument ("" stands for no argument).
_MESSAGING = ("kafka", "producer", "consumer", "amqp", "rabbit", "nats", "channel")
_DATABASES = ("sql", "db", "database", "mongo", "pg", "mysql", "sqlite", "sequelize", "typeorm", "prisma", "knex", "gorm", "sqlalchemy", "psycopg", "pymysql", "drivermanager", "hikari")
_CACHES = ("redis", "jedis", "lettuce", "ioredis", "redisson")
_GRPC = {"r_has": ("grpc",), "r_ends": ("pb", "_grpc")}
CALL_RULES: tuple[tuple[str, dict[str, tuple[str, ...]]], ...] = (
    ("grpc_client", _GRPC | {"m_has": ("dial", "channel", "newclient")}),
    ("grpc_client", _GRPC | {"m_starts": ("new",), "m_ends": ("client",)}),
    ("grpc_server", _GRPC | {"m_has": ("serve", "register", "server", "add_insecure_port")}),
    ("http_client", {"m_is": ("get", "post", "put", "delete", "patch", "head", "options", "request"), "a_starts": ("http://", "https://", "/")}),
    ("http_client", {"m_is": ("fetch", "urlopen", "openconnection")}),
    ("http_client", {"r_has": ("http", "request", "axios", "resty"), "m_is": ("get", "post", "put", "delete", "patch", "do", "execute", "send", "request")}),
    ("http_client", {"m_is": ("newrequest", "newrequestwithcontext")}),
    ("http_server", {"m_is": ("listenandserve", "listenandservetls", "listen", "run", "start", "serve"), "r_has": ("server", "app", "engine", "http"), "a_has": (":", "")}),
    ("http_server", {"m_is": ("handlefunc", "handle", "route", "add_url_rule")}),
    ("http_server", {"m_is": ("createserver",), "r_has": ("http", "https")}),
    ("websocket_client", {"r_has": ("websocket", "ws"), "m_is": ("connect", "dial", "dialcontext", "seturl", "handshake", "async_handshake")}),
    ("websocket_server", {"r_has": ("websocket", "ws"), "m_is": ("upgrade", "accept", "async_accept", "serve", "listen")}),
    ("websocket_client", {"m_is": ("websocket",), "a_starts": ("ws",)}),
    ("kafka_producer", {"r_has": _MESSAGING, "m_has": ("produce", "send", "publish", "write")}),
    ("kafka_consumer", {"r_has": _MESSAGING, "m_has": ("consume", "subscribe", "read", "receive")}),
    ("kafka_producer", {"r_has": _MESSAGING, "m_is": ("kafkaproducer", "producer")}),
    ("kafka_consumer", {"r_has": _MESSAGING, "m_is": ("kafkaconsumer", "consumer")}),
    ("database", {"r_has": _DATABASES, "m_is": ("open", "connect", "getconnection", "create_engine", "createconnection", "createpool")}),
    ("database", {"r_has": _DATABASES, "m_has": ("connect",)}),
    ("database", {"m_is": ("create_engine", "create_async_engine")}),
    ("redis", {"r_has": _CACHES, "m_has": ("connect", "create")}),
    ("redis", {"r_has": _CACHES, "m_is": ("dial", "dialurl", "newclient", "from_url", "redis", "strictredis")}),
    ("redis", {"r_has": _CACHES, "m_starts": ("new",)}),
    ("sqs", {"r_has": ("sqs",), "m_has": ("send", "receive")}),
    ("s3", {"r_has": ("s3",), "r_lacks": ("s3c",), "m_has": ("put", "upload", "get", "download")}),
    ("tcp_dial", {"m_is": ("dial", "dialtimeout", "dialcontext"), "r_has": ("net",), "r_is": ("",)}),
    ("tcp_dial", {"m_is": ("connect", "create_connection", "open_connection"), "r_has": ("socket", "net", "tcp", "tls")}),
    ("tcp_listen", {"m_is": ("listen", "bind", "start_server"), "r_has": ("net", "socket", "tcp", "server")}),
)


def _rule_holds(rule: dict[str, tuple[str, ...]], fields: dict[str, Column]) -> Column:
    """All sides of a rule: for receiver and argument any of their tests, for the method each field of tests."""
    receiver, method, argument = fields["r"], fields["m"], fields["a"]
    tests = []
    on_receiver = [F.contains(receiver, F.lit(w)) for w in rule.get("r_has", ())]
    on_receiver += [receiver.endswith(w) for w in rule.get("r_ends", ())] + [receiver == w for w in rule.get("r_is", ())]
    if on_receiver:
        tests.append(any_of(on_receiver))
    tests += [~has_any(receiver, *rule["r_lacks"])] if "r_lacks" in rule else []
    tests += [method.isin(*rule["m_is"])] if "m_is" in rule else []
    tests += [has_any(method, *rule["m_has"])] if "m_has" in rule else []
    tests += [any_of([method.startswith(w) for w in rule["m_starts"]])] if "m_starts" in rule else []
    tests += [any_of([method.endswith(w) for w in rule["m_ends"]])] if "m_ends" in rule else []
    tests += [any_of([argument.startswith(w) for w in rule["a_starts"]])] if "a_starts" in rule else []
    tests += [any_of([argument == w if w == "" else F.contains(argument, F.lit(w)) for w in rule["a_has"]])] if "a_has" in rule else []
    return reduce(and_, tests)


def call_kind(receiver: Column, method: Column, argument: Column) -> Column:
    """The kind of a network call by its names alone, null if they say nothing."""
    fields = {"r": F.lower(receiver), "m": F.lower(method), "a": F.lower(argument)}
    return first_that(None, *((_rule_holds(rule, fields), kind) for kind, rule in CALL_RULES))


# Words in import paths and receivers that mean networking.
IMPORT_WORDS = (
    "http", "grpc", "websocket", "ws", "socket", "net/", "net.", "tcp", "tls", "ssl", "udp",
    "kafka", "amqp", "rabbit", "nats", "mqtt", "pulsar", "celery",
    "redis", "mongo", "sql", "database", "postgres", "mysql", "sqlite", "gorm", "sqlalchemy", "psycopg", "pymysql", "sequelize", "typeorm",
    "prisma", "knex", "hikari", "jedis", "lettuce", "ioredis", "redisson",
    "sqs", "s3", "boto", "aws-sdk", "cloud.google",
    "axios", "requests", "aiohttp", "httpx", "urllib", "resty", "okhttp", "retrofit",
    "connectrpc", "tonic", "tarpc", "thrift", "consul", "eureka", "etcd", "zookeeper",
)
# Methods that open or close a connection, and what constructors that matter build.
LIFECYCLE = ("dial", "dialcontext", "dialtimeout", "dialtls", "connect", "connectasync", "open_connection", "create_connection", "listen", "listenandserve", "listenandservetls", "serve", "serveasync", "servehttp", "bind", "accept", "upgrade")
BUILT = ("client", "server", "channel", "stub", "connection", "conn", "producer", "consumer", "listener", "dialer", "transport", "socket", "pool", "session")
SHORT_RECEIVERS = ("ws", "s3", "db", "mq")
REGISTERED = ("server", "handler", "service", "endpoint")


def looks_like_ip(text: Column) -> Column:
    return text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def may_be_network(receiver: Column, method: Column, argument: Column, imports: Column) -> Column:
    """Whether a call is worth a look: its argument is an address, or its imports, receiver or method are those of networking."""
    r, m, a = F.lower(receiver), F.lower(method), F.lower(argument)
    address = F.contains(a, F.lit("://")) | a.rlike(r"(?s)^.+:[0-9]+$") | F.contains(a, F.lit("localhost")) | looks_like_ip(a)
    imported = F.exists(imports, lambda p: has_any(F.lower(p), *IMPORT_WORDS))
    named = has_any(r, *(w for w in IMPORT_WORDS if len(w) >= 3)) | r.isin(*SHORT_RECEIVERS)
    built = any_of([m.rlike(rf"(?s)^(new|create).*({'|'.join(BUILT)})")])
    registers = m.rlike(rf"(?s)^register.*({'|'.join(REGISTERED)})")
    return address | F.coalesce(imported, F.lit(False)) | named | m.isin(*LIFECYCLE) | built | registers
