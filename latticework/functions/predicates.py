"""Predicates on names, values and file paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.classify import any_of, has_any
from latticework.functions.paths import let

# Parts, ends and beginnings of lower-cased paths that hold no production code.
NOISE_PARTS = ("/test/", "/tests/", "e2e_test/", "/testutil/", "/testdata/", "test_", "/archive/", "/examples/", "/example/", "/vendor/", "/third_party/", "/dist/", "/build/", "/node_modules/", "wasm/build/", "/wasm/", "demo/")
NOISE_ENDS = ("_test.go", ".min.js")
NOISE_STARTS = ("archive/", "examples/", "demo/", "e2e_test/", "test/")
# Schemes of network addresses in configured values.
SCHEMES = ("http", "https", "ws", "wss", "grpc", "grpcs", "postgres", "postgresql", "mysql", "redis", "amqp", "amqps", "mongodb", "mongodb+srv")
# Parts of the names of variables that hold an address.
ADDRESS_NAMES = ("URL", "URI", "ADDR", "HOST", "ENDPOINT", "DATABASE", "REDIS", "KAFKA", "CONNECTION")


def noise_path(path: Column) -> Column:
    p = F.lower(path)
    return has_any(p, *NOISE_PARTS) | any_of([p.endswith(x) for x in NOISE_ENDS]) | any_of([p.startswith(x) for x in NOISE_STARTS])


# Ends of the names of test files, and lower-cased folders of tests; Python's are told by their stem.
TEST_ENDS = ("_test.go", "_test.rs", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".test-d.ts", "Test.java", "Tests.java", "IT.java", "_test.cc", "_test.cpp", "_test.c")
TEST_FOLDERS = ("/test/", "/__tests__/", "/spec/", "/testdata/", "/fixtures/")
# Ends of the names of files that protocol compilers write.
GENERATED_ENDS = ("_pb2_grpc.py", "_pb2.py", ".pb.go", "_grpc_pb.js", "_pb.js", "_grpc_pb.d.ts", "Grpc.java")


def test_path(path: Column) -> Column:
    """Files of tests, by the customs of the languages."""
    name, path = F.substring_index(path, "/", -1), F.concat(F.lit("/"), path)
    return any_of([name.endswith(e) for e in TEST_ENDS]) | name.rlike(r"^test_.*\.py$|_test\.py$") | F.contains(path, F.lit("/tests/")) | has_any(F.lower(path), *TEST_FOLDERS)


def generated_path(path: Column) -> Column:
    """Files that protocol compilers write."""
    return any_of([path.endswith(e) for e in GENERATED_ENDS])


def env_name_strict(name: Column) -> Column:
    """Capital letters, digits and underscores only."""
    return name.rlike("^[A-Z0-9_]+$")


def env_name_loose(name: Column, least: int = 2) -> Column:
    """Letters, digits, underscores and dots, six letters of ten in capitals."""
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(name, "[^A-Z]", ""))
    return (F.length(name) >= least) & (letters > 0) & (F.floor(capitals * 100 / letters) >= 60) & name.rlike(r"^[A-Za-z0-9_.]*$")


def address_variable(name: Column) -> Column:
    up = F.upper(name)
    return has_any(up, *ADDRESS_NAMES) | up.endswith("_DSN")


def host_port(value: Column) -> Column:
    """``host:port``, a path after it allowed, with a letter in the host and no scheme."""
    host = F.regexp_extract(value, r"(?s)^(.*):", 1)
    port = F.substring_index(F.regexp_extract(value, r"(?s)^.*:(.*)$", 1), "/", 1)
    return F.contains(value, F.lit(":")) & port.rlike("^[0-9]+$") & host.rlike("[A-Za-z]") & ~F.contains(host, F.lit("//"))


def network_value(value: Column) -> Column:
    v = F.lower(value)
    return any_of([v.startswith(f"{s}://") for s in SCHEMES]) | F.contains(v, F.lit(".svc.cluster.local")) | host_port(v)


# What an address has, starts with or ends in.
ADDRESS_PARTS, ADDRESS_STARTS, ADDRESS_ENDS = ("://", "localhost"), (":", "http", "grpc"), (".com", ".io", ".net", ".local")


def address_like(value: Column) -> Column:
    """What an argument looks like if it names a peer."""
    sided = any_of([value.startswith(s) for s in ADDRESS_STARTS] + [value.endswith(e) for e in ADDRESS_ENDS])
    return has_any(value, *ADDRESS_PARTS) | (F.contains(value, F.lit(":")) & value.rlike("[0-9]")) | sided


def cross_repo(a: Column, b: Column) -> Column:
    """Different, or known on one side only."""
    return ~a.eqNullSafe(b)


def glob(text: Column, pattern: str) -> Column:
    """``*`` stands for anything. The parts between are sought from the left, each as early as possible, and the last must then end the
    text unless a star does: so ``*a`` does not match ``aXa``, as the first ``a`` is taken."""
    if pattern == "*":
        return F.lit(True)
    parts = pattern.split("*")
    if len(parts) == 1:
        return text == pattern
    start = re.escape(parts[0]) if parts[0] else ""
    rest = "".join(f"(?>.*?{re.escape(p)})" for p in parts[1:] if p)
    return text.rlike(rf"(?s)\A{start}{rest}" + (r"" if parts[-1] == "" else r"\z"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


# ---- templates ------------------------------------------------------------------------------------------------------------------


def without_templates(value: Column) -> Column:
    """Template expressions as ``{template}``; one that has no end stays."""
    return F.regexp_replace(value, r"(?s)\{\{.*?\}\}", "{template}")


def template_value(raw: Column) -> Column:
    """What a template value comes to: its default, else the reference in it, else itself."""
    return let(F.trim(raw), lambda s: F.when(~F.contains(s, F.lit("{{")), s).otherwise(F.coalesce(_default(s), _reference(s), s)))


def _default(s: Column) -> Column:
    """What follows ``default``: quoted by whichever quote comes first and ends, else up to a space or brace; null without it."""

    def of(after: Column) -> Column:
        quoted = F.regexp_extract(after, r"""(?s)^[^"'`]*("[^"]*"|'[^']*'|`[^`]*`)""", 1)
        return F.when(quoted != "", F.regexp_extract(quoted, r"(?s)^.(.*).$", 1)).otherwise(F.nullif(F.regexp_extract(after, r"^([^ }]*)", 1), F.lit("")))

    return F.when(F.contains(s, F.lit("default ")), let(F.trim(F.regexp_extract(s, r"(?s)^.*?default (.*)$", 1)), of))


def _reference(s: Column) -> Column:
    """What a template alone refers to."""
    inner = F.trim(F.substring_index(F.trim(F.regexp_replace(s, r"^\{+|\}+$", "")), "|", 1))
    return F.when(s.startswith("{{") & s.endswith("}}"), F.nullif(inner, F.lit("")))
