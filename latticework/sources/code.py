"""Facts from source code: definitions, calls, imports, constants, routes and reads of the environment.

Python is parsed by its own grammar; other languages, and Python that this grammar rejects (a fact ``unparsed`` tells so), by line patterns,
which see what stands on one line. Each file is parsed by itself in Arrow batches, and every kind of fact is a filter of one table of facts.

An ``assign`` fact has the name assigned to, in receiver the kind of what is assigned (literal, env, variable, call, parameter) and its value.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.classify import call_kind, grpc_service

FACTS = "repo string, file string, language string, fact string, name string, receiver string, value string, arg2 string, line int, end_line int, owner string, arg_name string"
_COLUMNS = [f.split()[0] for f in FACTS.split(", ")]
_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")

_DEF = {
    "go": r"^func\s+(?:\(\s*\w*\s*\*?([\w.]+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*[\[(]",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>",
    "c": r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w*&:<>,\s]+?\b(?P<name>\w+)\s*\([^;]*\)\s*(?:const)?\s*\{",
    "python": r"^\s*(?:async\s+)?def\s+(?P<name>\w+)",
    "java": r"^\s*(?:public|private|protected|static|final|abstract|synchronized|\s)+[\w<>\[\],.\s]+\s(?P<name>\w+)\s*\([^;]*\)\s*(?:throws [\w,.\s]+)?\{",
}
_DEF["cpp"] = _DEF["c"]
_TYPE = {
    "go": r"^type\s+(?P<name>\w+)\s+(?:struct|interface)",
    "typescript": r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|enum|type)\s+(?P<name>\w+)",
    "python": r"^\s*class\s+(?P<name>\w+)",
    "c": r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*\{?",
    "cpp": r"^\s*(?:class|struct|enum(?:\s+class)?)\s+(?P<name>\w+)[^;]*\{?$",
    "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+(?P<name>\w+)",
}
_IMPORT = {
    "go": r"""^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"]+)"\s*$""",
    "typescript": r"""^\s*import\s+(?:(?P<alias>\w+)|[^'"]*?)\s*(?:,?\s*\{[^}]*\}\s*)?(?:from\s*)?['"](?P<path>[^'"]+)['"]|(?:const|let|var)\s+(?P<alias2>\w+)\s*=\s*require\(['"](?P<path2>[^'"]+)['"]\)""",
    "python": r"^\s*from\s+(?P<path>[\w.]+)\s+import\s+(?P<alias>\w+)|^\s*import\s+(?P<path2>[\w.]+)(?:\s+as\s+(?P<alias2>\w+))?",
    "c": r"""^\s*#\s*include\s*[<"](?P<path>[^>"]+)[>"]""",
    "java": r"^\s*import\s+(?:static\s+)?(?P<path>[\w.*]+)\s*;",
}
_IMPORT["cpp"] = _IMPORT["c"]
_CONSTANT = r"""^\s*(?:export\s+)?(?:(?:public|private|static|final|const|constexpr|let|var|char|std::string|String|string|auto|\*)[\s*]+)+(?P<name>\w+)\s*(?:\[\])?\s*(?::\s*string\s*)?=\s*["'`](?P<value>[^"'`]*)["'`]|^\s*#\s*define\s+(?P<name2>\w+)\s+"(?P<value2>[^"]*)"|^\s*(?P<name3>\w+)\s*:=\s*["`](?P<value3>[^"`]*)["`]"""
_CALL = re.compile(r"""(?P<recv>(?:[A-Za-z_]\w*(?:\(\))?(?:\.|->|::))*)(?P<name>[A-Za-z_]\w*)\s*\(""")
_KEYWORDS = frozenset("if for while switch return catch func function else sizeof new typeof await defer go range select case def class elif with lambda and or not in assert del yield raise".split())
_ASSIGN = re.compile(r"^\s*(?:(?:export|const|let|var|final|static|auto|\w[\w<>\[\]]*(?:::\w[\w<>]*)*[*&]?)\s+)*[*&]?(?P<name>[\w.]+)(?:\s*,\s*\w+)*\s*(?::\s*[\w<>]+\s*)?(?::=|=)(?![=>])\s*(?P<value>.+?);?\s*$")
_ENV = re.compile(r"""(?:\b(?:os\.(?:Getenv|LookupEnv|getenv|environ\.get)|System\.getenv|(?:std::)?getenv)\(|\bos\.environ\[)\s*["']([^"']+)["']|process\.env(?:\.(\w+)|\[['"](\w+)['"]\])""")
_CALLED = re.compile(r"^(?:await\s+|new\s+)?([A-Za-z_][\w.]*(?:(?:::|->)\w+)*)\(")
_FIRST_NAME = re.compile(r"""^\s*(?:(?:"[^"]*"|'[^']*'|[\w.]+\(\))\s*,\s*)*([A-Za-z_][\w.]*)\s*[,)]""")
#: Rows of facts that are handed on at once.
ROWS = 20_000
_STRING = re.compile(r'''"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|`([^`]*)`''')


def _row(fact: str, name: str, line: int, **more) -> dict:
    return {"fact": fact, "name": name, "line": line, "end_line": more.pop("end", line), "receiver": None, "value": None, "arg2": None, "owner": None, "arg_name": None} | more


def _dotted(node: ast.AST) -> str | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        inner = _dotted(node.func)
        return ".".join([f"{inner}()", *reversed(parts)]) if inner else None
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _text(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{}" for v in node.values)
    return None


def _assigned(node: ast.AST | None) -> tuple[str, str] | None:
    """Kind and value of what an assignment's right side is, as far as it is told."""
    if (text := _text(node)) is not None:
        return "literal", text
    if isinstance(node, ast.Subscript) and _dotted(node.value) == "os.environ" and (key := _text(node.slice)):
        return "env", key
    if isinstance(node, ast.Call):
        called = _dotted(node.func)
        if called in ("os.getenv", "os.environ.get", "getenv") and node.args and (key := _text(node.args[0])):
            return "env", key
        return ("call", called) if called else None
    return ("variable", name) if node is not None and (name := _dotted(node)) else None


def python_facts(content: str) -> list[dict]:
    """Facts of a Python file; of one that the grammar rejects, those that its lines tell."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return [_row("unparsed", "python", 1), *line_facts(content, "python")]
    out: list[dict] = []

    def visit(node: ast.AST, owner: str | None, in_class: bool) -> None:
        skipped.update(getattr(node, "decorator_list", []))
        for child in ast.iter_child_nodes(node):
            inner, classy = owner, in_class
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(_row("method" if in_class else "function", child.name, child.lineno, end=child.end_lineno, owner=owner))
                for d in child.decorator_list:
                    call = d.func if isinstance(d, ast.Call) else d
                    first = _text(d.args[0]) if isinstance(d, ast.Call) and d.args else None
                    out.append(_row("decorator", _dotted(call) or "?", d.lineno, end=child.lineno, value=first, owner=child.name))
                inner, classy = child.name, False
                arguments = [*child.args.posonlyargs, *child.args.args]
                out.extend(_row("assign", a.arg, child.lineno, receiver="parameter", value=f"{child.name}:{k}", owner=child.name) for k, a in enumerate(arguments))
            elif isinstance(child, ast.ClassDef):
                out.append(_row("type", child.name, child.lineno, end=child.end_lineno, owner=owner))
                classy = True
            elif isinstance(child, ast.Import):
                out.extend(_row("import", a.asname or a.name.split(".")[0], child.lineno, value=a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend(_row("import", a.asname or a.name, child.lineno, value=f"{'.' * child.level}{child.module or ''}.{a.name}") for a in child.names)
            elif isinstance(child, ast.Assign | ast.AnnAssign):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                if made := _assigned(child.value):
                    out.extend(_row("assign", name, child.lineno, receiver=made[0], value=made[1], owner=owner) for t in targets if (name := _dotted(t)))
                if (value := _text(child.value)) is not None:
                    out.extend(_row("constant", t.id, child.lineno, value=value, owner=owner) for t in targets if isinstance(t, ast.Name))
            if child in skipped:
                continue
            if isinstance(child, ast.Call) and (full := _dotted(child.func)):
                receiver, _, name = full.rpartition(".")
                strings = [t for t in map(_text, child.args) if t is not None][:2] + [None, None]
                names = [n for a in child.args if not isinstance(a, ast.Call) and (n := _dotted(a))]
                out.append(_row("call", name, child.lineno, receiver=receiver or None, value=strings[0], arg2=strings[1], owner=owner, arg_name=names[0] if names else None))
            if isinstance(child, ast.Subscript) and _dotted(child.value) == "os.environ" and (value := _text(child.slice)):
                out.append(_row("env", value, child.lineno, owner=owner))
            for d in getattr(child, "decorator_list", []):
                for argument in [*d.args, *d.keywords] if isinstance(d, ast.Call) else []:
                    visit(argument, owner, in_class)
            visit(child, inner, classy)

    skipped: set[ast.AST] = set()
    visit(tree, None, False)
    return out


def _without_comments(line: str, inside: bool) -> tuple[str, bool]:
    if inside:
        _, end, rest = line.partition("*/")
        return ("", True) if not end else _without_comments(rest, False)
    line = re.sub(r"/\*.*?\*/", "", line)
    if "/*" in line and not re.search(r"""["'`][^"'`]*/\*""", line):
        return line.split("/*", 1)[0], True
    return re.sub(r"""^([^"'`]*?)//.*$""", r"\1", line), False


def _line_assigned(value: str) -> tuple[str, str] | None:
    """Kind and value of the right side of an assignment on one line."""
    if m := _ENV.search(value):
        return "env", next(filter(None, m.groups()))
    if (m := _STRING.match(value)) and m.end() == len(value):
        return "literal", "".join(filter(None, m.groups()))
    if re.fullmatch(r"[A-Za-z_][\w.]*", value):
        return "variable", value
    return ("call", m[1]) if (m := _CALLED.match(value)) else None


def line_facts(content: str, language: str) -> list[dict]:
    """Facts of a file by patterns on its lines."""
    out: list[dict] = []
    owner, inside = None, False
    patterns = [(f, re.compile(p[language])) for f, p in (("function", _DEF), ("type", _TYPE), ("import", _IMPORT)) if language in p]
    constant = re.compile(_CONSTANT)
    for number, raw in enumerate(content.split("\n"), 1):
        line, inside = (re.sub(r"""^([^"'#]*)#.*$""", r"\1", raw.rstrip("\r")), False) if language == "python" else _without_comments(raw.rstrip("\r"), inside)
        if not line.strip():
            continue
        defined = None
        for fact, pattern in patterns:
            if not (m := pattern.search(line)):
                continue
            groups = m.groupdict()
            if fact == "import":
                path = groups.get("path") or groups.get("path2")
                out.append(_row("import", groups.get("alias") or groups.get("alias2") or path.rstrip("/*;").split("/")[-1].split(".")[-1], number, value=path))
            else:
                defined = groups.get("name") or groups.get("name2")
                if fact == "function" and defined in _KEYWORDS:
                    continue
                out.append(_row(fact, defined, number))
                owner = defined if fact == "function" else owner
        if m := constant.search(line):
            which = m.groupdict()
            name, value = next((which[n], which[v]) for n, v in (("name", "value"), ("name2", "value2"), ("name3", "value3")) if which[n])
            out.append(_row("constant", name, number, value=value, owner=owner))
        if (m := _ASSIGN.match(line)) and (made := _line_assigned(m["value"])):
            out.append(_row("assign", m["name"], number, receiver=made[0], value=made[1], owner=owner))
        if m := re.search(r"process\.env(?:\.(\w+)|\[['\"](\w+)['\"]\])", line):
            out.append(_row("env", m[1] or m[2], number, owner=owner))
        for m in _CALL.finditer(line):
            if m["name"] in _KEYWORDS or (m["name"] == defined and not m["recv"]):
                continue
            strings = ["".join(filter(None, s.groups())) for s in _STRING.finditer(line[m.end() :])][:2] + [None, None]
            variable = _FIRST_NAME.match(line[m.end() :])
            out.append(_row("call", m["name"], number, receiver=re.sub(r"(\.|->|::)$", "", m["recv"]) or None, value=strings[0], arg2=strings[1], owner=owner, arg_name=variable[1] if variable else None))
    starts = [r for r in out if r["fact"] == "function"]
    for one, after in zip(starts, starts[1:] + [None], strict=False):  # a function reaches to the next one
        one["end_line"] = after["line"] - 1 if after else content.count("\n") + 1
    return out


def facts(files: DataFrame) -> DataFrame:
    """FACTS of files (repo, file, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for batch in batches:
            for repo, file, language, content in batch.itertuples(index=False):
                found = python_facts(content or "") if language == "python" else line_facts(content or "", language)
                rows += [{"repo": repo, "file": file, "language": language} | r for r in found]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
        yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.where("language is not null").select("repo", "file", "language", "content").mapInPandas(run, FACTS)


def propagated(found: DataFrame) -> DataFrame:
    """found, in which a call without a string has the value of the constant that it names: the last of the same function before it, else of the file."""
    calls = found.where("fact = 'call' and value is null and arg_name is not null").select("repo", "file", "line", "owner", "arg_name").distinct()
    constants = found.where("fact = 'constant'").select("repo", "file", F.col("name").alias("arg_name"), F.col("line").alias("at"), F.col("owner").alias("scope"), F.col("value").alias("constant"))
    own = F.col("scope").eqNullSafe(F.col("owner"))
    met = calls.join(constants, ["repo", "file", "arg_name"]).where((own & (F.col("at") <= F.col("line"))) | F.col("scope").isNull())
    best = met.groupBy("repo", "file", "line", "owner", "arg_name").agg(F.max_by("constant", F.struct(own, "at")).alias("constant"))
    best = best.select(*(F.col(c).alias(f"b_{c}") for c in ("repo", "file", "line", "owner", "arg_name")), "constant")
    same = [F.col(c) == F.col(f"b_{c}") for c in ("repo", "file", "line", "arg_name")]
    rows = found.join(best, [*same, F.col("owner").eqNullSafe(F.col("b_owner")), F.col("fact") == "call", F.col("value").isNull()], "left")
    return rows.withColumn("value", F.coalesce("value", "constant")).select(*found.columns)


# ---- what facts mean ------------------------------------------------------------------------------------------------------------


def env_reads(found: DataFrame) -> DataFrame:
    """repo, var_name, file, line and owner of reads of the environment."""
    by_call = (F.col("fact") == "call") & F.lower("name").isin("getenv", "lookupenv") | (F.concat_ws(".", "receiver", "name") == "os.environ.get")
    var = F.when(F.col("fact") == "env", F.col("name")).when(by_call, F.col("value"))
    return found.withColumn("var_name", var).where("var_name is not null").select("repo", "var_name", "file", "line", "owner")


def setting_reads(found: DataFrame) -> DataFrame:
    """repo, file, line, owner, kind (env, config or flag) and key of calls that read a setting by its name."""
    r, n = F.lower(F.coalesce("receiver", F.lit(""))), F.lower("name")
    env = (r.isin("os", "system", "") & n.isin("getenv", "lookupenv")) | ((r == "os.environ") & (n == "get")) | (r == "process.env") | n.rlike("getenv|mustmapenv|env_or|^envvar$")
    config = (F.contains(r, F.lit("viper")) & n.startswith("get")) | (r.rlike("config|settings") & n.isin("get", "getattr")) | n.isin("getconfig", "get_config", "read_config")
    flag = (F.contains(r, F.lit("flag")) & n.isin("string", "int", "bool", "var")) | (F.contains(r, F.lit("parser")) & (n == "add_argument"))
    kind = F.when(env, "env").when(config, "config").when(flag, "flag")
    rows = found.where("fact = 'call' and value is not null").select("repo", "file", "line", "owner", kind.alias("kind"), F.col("value").alias("key"))
    direct = found.where("fact = 'env'").select("repo", "file", "line", "owner", F.lit("env").alias("kind"), F.col("name").alias("key"))
    return rows.where("kind is not null").unionByName(direct)


def assignments(found: DataFrame) -> DataFrame:
    """repo, file, at, name, kind and value of all assignments: what provenance.trace_back() follows."""
    return found.where("fact = 'assign'").select("repo", "file", F.col("line").alias("at"), "name", F.col("receiver").alias("kind"), "value")


def http_routes(found: DataFrame) -> DataFrame:
    """repo, path, method, framework, file, line, owner and site (the line of what a decorator stands on) of routes that are registered by calls or decorators with a path."""
    lower = F.lower("name")
    verb = F.when(lower.isin(*_VERBS), F.upper("name"))
    by_call = (F.col("fact") == "call") & F.col("value").startswith("/") & (lower.isin("handlefunc", "handle", "route", "add_url_rule", "path", "re_path") | (lower.isin(*_VERBS) & F.lower(F.coalesce("receiver", F.lit(""))).rlike(r"(router|app|mux|engine|server|^r|^e|^g)$")))
    last = F.lower(F.substring_index("name", ".", -1))
    by_decorator = (F.col("fact") == "decorator") & F.col("value").startswith("/") & (last.isin(*_VERBS) | last.isin("route", "websocket"))
    method = F.when(F.col("fact") == "decorator", F.when(last.isin(*_VERBS), F.upper(last)).otherwise("")).otherwise(F.coalesce(verb, F.lit("")))
    rows = found.where(by_call | by_decorator)
    return rows.select("repo", F.col("value").alias("path"), method.alias("method"), F.col("language").alias("framework"), "file", "line", "owner", F.when(F.col("fact") == "decorator", F.col("end_line")).otherwise(F.col("line")).alias("site"))


def http_calls(found: DataFrame) -> DataFrame:
    """repo, path, method, file, line and owner of calls with a URL."""
    lower = F.lower("name")
    client = (F.col("fact") == "call") & (lower.isin(*_VERBS, "fetch", "request", "urlopen", "newrequest", "newrequestwithcontext"))
    url = F.when(F.col("value").rlike("^https?://"), F.col("value")).when(F.col("arg2").rlike("^https?://"), F.col("arg2"))
    method = F.when(lower.isin(*_VERBS), F.upper("name")).when(F.upper("value").isin(*(v.upper() for v in _VERBS)), F.upper("value")).otherwise("")
    rows = found.withColumn("url", url).where(client & F.col("url").isNotNull())
    return rows.select("repo", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1).alias("path"), method.alias("method"), "file", "line", "owner", "url")


def grpc_sites(found: DataFrame) -> DataFrame:
    """repo, service_name, side (client or server), file and line of generated gRPC calls."""
    name = F.col("name")
    side = F.when(name.rlike(r"^(New\w+Client|\w+Stub)$"), "client").when(name.rlike(r"^(Register\w+Server|add_\w+Servicer_to_server)$"), "server")
    rows = found.where("fact = 'call'").withColumn("side", side).withColumn("service_name", grpc_service(name)).where("side is not null and service_name is not null")
    return rows.select("repo", "service_name", "side", "file", "line")


def same_file_calls(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls answered by the first function of that name in the same file (repo, file, caller, callee), and the unresolved ones (repo, file, caller, name)."""
    defs = found.where("fact in ('function', 'method')").groupBy("repo", "file", "name").agg(F.min("line").alias("at"))
    sites = found.where("fact = 'call' and owner is not null").select("repo", "file", F.col("owner").alias("caller"), "name").distinct()
    met = sites.join(defs, ["repo", "file", "name"], "left")
    return met.where("at is not null and caller <> name").select("repo", "file", "caller", F.col("name").alias("callee")), met.where("at is null").select("repo", "file", "caller", "name")


def nextjs_routes(found: DataFrame) -> DataFrame:
    """repo, file, line and name (``VERB /api/...``) of route files that export verbs."""
    path = F.regexp_extract("file", r"(?:^|/)app(/api(?:/.+)?)/route\.[jt]sx?$", 1)
    rows = found.where("fact = 'function'").withColumn("path", path).where((F.col("path") != "") & F.col("name").isin("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"))
    return rows.select("repo", "file", "line", F.concat_ws(" ", "name", "path").alias("name"))


def connections(found: DataFrame) -> DataFrame:
    """repo, file, line, owner, kind and name of calls that open or use a connection which is no HTTP or gRPC call.

    Queues are named by their topic, WebSockets by their path or ``websocket``, and other resources by their address or else by the
    receiver or method that stands for them.
    """
    kind = call_kind(F.coalesce("receiver", F.lit("")), F.col("name"), F.coalesce("value", F.lit("")))
    kinds = ("websocket_client", "websocket_server", "kafka_producer", "kafka_consumer", "database", "redis", "sqs", "s3")
    rows = found.where("fact = 'call'").withColumn("kind", kind).where(F.col("kind").isin(*kinds))
    decorated = found.where("fact = 'decorator' and value like '/%' and lower(name) rlike '(^|[.])websocket$'").withColumn("kind", F.lit("websocket_server"))
    rows = rows.unionByName(decorated)
    ws_path = F.regexp_extract("value", r"^(?:wss?://[^/]*)?(/.*)$", 1)
    by_socket = F.coalesce(F.nullif(ws_path, F.lit("")), F.lit("websocket"))
    topic = F.when(~F.col("kind").startswith("kafka") | (F.coalesce("value", F.lit("")) != ""), F.coalesce(F.nullif("value", F.lit("")), F.substring_index("receiver", ".", -1), F.col("name")))
    name = F.when(F.col("kind").startswith("websocket"), by_socket).otherwise(topic)
    site = F.when(F.col("fact") == "decorator", F.col("end_line")).otherwise(F.col("line"))
    return rows.withColumn("name", name).where("name is not null").select("repo", "file", site.alias("line"), "owner", "kind", "name")
