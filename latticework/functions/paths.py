"""Kernels for URL paths, WebSocket paths, service addresses and image references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that say nothing about what serves them.
TRIVIAL_PATHS = ("/", "/health", "/healthz", "/ready", "/readyz", "/livez", "/metrics", "/status", "/ping", "/version", "/favicon.ico")
# Environment suffixes of service names.
ENV_SUFFIXES = ("-staging", "-production", "-prod", "-dev", "-test", "-canary", "-preview")
#: Segments that the shorter path of a prefix match must have.
MIN_PREFIX_SEGMENTS = 2


def rest_path(path: Column) -> Column:
    """Lower case, without trailing slashes, double slashes halved once; the empty path is ``/``."""
    bare = F.regexp_replace(F.lower(F.trim(path)), r"/+$", "")
    return F.when(bare == "", "/").otherwise(F.replace(bare, F.lit("//"), F.lit("/")))


def segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def is_trivial(norm_path: Column) -> Column:
    return norm_path.isin(*TRIVIAL_PATHS)


def ws_path(address: Column) -> Column:
    """What follows the host of a WebSocket address; a path alone is itself."""
    bare = F.trim(address)
    after = F.regexp_replace(bare, r"(?s)^.*?://", "")
    return F.when(bare.startswith("/"), bare).when(F.instr(after, "/") > 0, F.regexp_extract(after, r"(?s)(/.*)$", 1)).otherwise("/")


def ws_norm(path: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(path)), r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often then names it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def port_number(text: Column) -> Column:
    """A port from 0 to 65535, null for all else."""
    n = F.regexp_extract(text, r"^\+?0*([0-9]{1,5})$", 1).try_cast("int")
    return F.when(n <= 65535, n)


def _host_port(text: Column, then) -> Column:
    """then(host, port): the port after the last colon if that is one; else all is host."""
    port = F.when(F.instr(text, ":") > 0, port_number(F.substring_index(text, ":", -1)))
    return let(F.struct(text.alias("text"), port.alias("port")), lambda s: then(F.when(s["port"].isNotNull(), F.regexp_replace(s["text"], ":[^:]*$", "")).otherwise(s["text"]), s["port"]))


def without_env_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "(" + "|".join(ENV_SUFFIXES) + ")$", "")


def k8s_dns(url: Column) -> Column:
    """(service, namespace, host, port, path) of an address in a cluster's DNS, null for other addresses.

    Cluster names have the label ``svc`` as the third or later one. The service is the first label without an environment suffix.
    """
    after = F.regexp_extract(F.trim(url), r"(?s)^(?:.*?://)?(.*?)(?:://.*)?$", 1)

    def parts(after: Column) -> Column:
        path = F.when(F.instr(after, "/") > 0, F.regexp_extract(after, r"(?s)^[^/]*(/.*)$", 1)).otherwise("/")
        return _host_port(F.substring_index(after, "/", 1), lambda host, port: let(F.struct(host.alias("host"), F.split(host, r"\.").alias("labels"), port.alias("port"), path.alias("path")), cluster))

    def cluster(s: Column) -> Column:
        found = F.struct(without_env_suffix(F.get(s["labels"], F.lit(0))).alias("service"), F.get(s["labels"], F.lit(1)).alias("namespace"), s["host"], s["port"], s["path"])
        return F.when(F.array_position(s["labels"], F.lit("svc")) >= 3, found)

    return let(after, parts)


def service_value(value: Column) -> Column:
    """(service, port) that a configured value points to, null if it can be no service."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r'^"+|"+$', ""), r"^'+|'+$", "")

    def named(authority: Column) -> Column:
        return _host_port(authority, lambda host, port: let(F.struct(F.when(F.instr(authority, ".") > 0, F.substring_index(authority, ".", 1)).otherwise(F.substring_index(host, ":", 1)).alias("service"), port.alias("port")), checked))

    def checked(s: Column) -> Column:
        name = s["service"]
        return F.when(~((name == "") | (F.instr(name, " ") > 0) | name.startswith("{{") | port_number(name).isNotNull()), s)

    return let(F.regexp_extract(bare, r"(?s)^(?:.*?://)?([^/]*)", 1), named)


def image_path(ref: Column) -> Column:
    """An image reference without its digest, or else without its tag; a registry's port is no tag."""
    bare = F.trim(ref)
    return F.when(F.instr(bare, "@") > 0, F.substring_index(bare, "@", 1)).otherwise(F.regexp_replace(bare, r":[^/:]*$", ""))


def image_name(ref: Column) -> Column:
    return F.substring_index(image_path(ref), "/", -1)


def url_path(url: Column) -> Column:
    """The path of a URL or a bare path, null for none and for the root."""
    after = F.regexp_extract(url, r"(?s)^.*?://[^/]*(/.*)$", 1)
    return F.when(F.length(after) > 1, after).when(url.startswith("/") & (F.length(url) > 1), url)


def hint_path(hint: Column) -> Column:
    """The first word of a hint that is a path, without closing parentheses; null for none."""
    words = F.transform(F.split(hint, r"\s+"), lambda w: F.regexp_replace(w, r"\)+$", ""))
    return F.get(F.filter(words, lambda w: w.startswith("/") & (F.length(w) > 1)), F.lit(0))


def address_hint(source: Column, chain: Column | None = None, target: Column | None = None) -> Column:
    """What is known of an address: the path in a rendered chain or the chain, else by the JSON source, else the target's name."""
    read = lambda path: F.get_json_object(source, path)
    dynamic = read("$.Dynamic.hint")
    known = [read("$.Literal.value"), hint_path(dynamic), dynamic, read("$.EnvVar.k8s_value"), F.concat(F.lit("env:"), read("$.EnvVar.var_name"))]
    return F.coalesce(*([hint_path(chain), chain] if chain is not None else []), *known, *([target] if target is not None else []), F.lit(""))


def import_alias(path: Column, language: Column) -> Column:
    """The name under which an import is used without an alias of its own; null where a language has none.

    Go's is the last segment, without a version suffix of one digit; Java's what follows the last dot.
    """
    go = F.substring_index(F.regexp_replace(path, r"/v[0-9]$", ""), "/", -1)
    return F.when(language == "go", go).when(language == "python", path).when(language == "java", F.substring_index(path, ".", -1)).when(language == "typescript", F.substring_index(path, "/", -1))


# ---- repositories ---------------------------------------------------------------------------------------------------------------


def repo_name(path: Column) -> Column:
    """The last component of a repository's path, ``repo`` without one."""
    return F.coalesce(F.nullif(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1), F.lit("")), F.lit("repo"))


def is_git_url(text: Column) -> Column:
    return text.rlike(r"^(https?://|git@|ssh://)") | text.endswith(".git")


def repo_name_of_url(url: Column) -> Column:
    """What follows the last slash, without the ending."""
    return F.substring_index(F.regexp_replace(url, r"(\.git)+$", ""), "/", -1)


def graph_name(number: Column, path: Column) -> Column:
    """The name of a repository's stored graph: its number in four digits and its name."""
    return F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("-"), repo_name(path))
