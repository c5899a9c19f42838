"""Where an address comes from: trees of sources, kept as JSON and as flat arrays.

A tree is JSON of one key, the kind of source, over its fields; the fields ``source``, ``sources`` and ``parts`` hold further trees.
flattened() lists a tree's nodes in pre-order with built-in functions, to a depth of MAX_DEPTH; rendering is recursive and so done in
batches in Python.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.operators.matching import enclosing
from latticework.storage import stored

MAX_DEPTH = 10
ARROW = " <- "


def _children(tree: object) -> list:
    if not isinstance(tree, dict) or len(tree) != 1:
        return []
    (fields,) = tree.values()
    if not isinstance(fields, dict):
        return []
    below = [fields[k] for k in ("source", "callee_return", "base", "default") if isinstance(fields.get(k), dict)]
    for k in ("parts", "sources", "alternatives", "caller_sources", "assignment_sources"):
        below += [x for x in fields.get(k) or [] if isinstance(x, dict)]
    return below


def nodes_of(tree: object, depth: int = 0) -> list[tuple[int, str, str]]:
    """(depth, kind, text) of a tree's nodes in pre-order."""
    if isinstance(tree, str):
        return [(depth, tree, "")]
    if not isinstance(tree, dict) or len(tree) != 1 or depth > MAX_DEPTH:
        return []
    ((kind, fields),) = tree.items()
    texts = [str(v) for v in fields.values() if isinstance(v, (str, int)) and not isinstance(v, bool)] if isinstance(fields, dict) else [str(fields)]
    out = [(depth, kind, " ".join(texts))]
    for child in _children(tree):
        out += nodes_of(child, depth + 1)
    return out


_FLAT = T.ArrayType(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_FLAT)
def flattened(trees: pd.Series) -> pd.Series:
    """The nodes of each JSON tree; what is no JSON has none."""

    def one(text):
        try:
            return [{"depth": d, "kind": k, "text": t} for d, k, t in nodes_of(json.loads(text))]
        except (TypeError, ValueError):
            return []

    return trees.map(one)


@F.pandas_udf(T.StringType())
def formatted(trees: pd.Series) -> pd.Series:
    """Each tree as one line: a chain by arrows, the parts of a concatenation by plus signs, alternatives by bars."""

    def one(tree) -> str:
        if isinstance(tree, str):
            return tree.lower()
        if not isinstance(tree, dict) or len(tree) != 1:
            return "?"
        ((kind, fields),) = tree.items()
        own = nodes_of({kind: {k: v for k, v in fields.items() if not isinstance(v, (dict, list))} if isinstance(fields, dict) else fields})[0][2]
        label = f"{kind}({own})" if own else kind
        below = [one(c) for c in _children(tree)]
        if not below:
            return label
        return label + ARROW + {"Concat": " + ", "Parameter": " | "}.get(kind, ", ").join(below)

    def line(text):
        try:
            return one(json.loads(text))
        except (TypeError, ValueError):
            return None

    return trees.map(line)


#: How much of a value and of a variable's known value is shown.
SHOWN_VALUE, SHOWN_BOUND = 50, 40


def _cut(text: object, most: int) -> str:
    text = str(text)
    return text if len(text) <= most else text[:most] + "..."


def _shown(tree: object) -> str:
    """A tree in the style of traces: calls with their fields, and in brackets behind an arrow what they come from."""
    if not isinstance(tree, dict) or len(tree) != 1:
        return "dynamic"
    ((kind, fields),) = tree.items()
    get = fields.get if isinstance(fields, dict) else lambda *_: None
    below = ", ".join(map(_shown, _children(tree)))
    if kind == "Concat":
        return " + ".join(map(_shown, _children(tree)))
    if kind == "Literal":
        return f'"{_cut(get("value"), SHOWN_VALUE)}"'
    if kind == "EnvVar":
        bound = get("k8s_value")
        return f"env({get('var_name')})" + (f' = "{_cut(bound, SHOWN_BOUND)}"' if bound is not None else "")
    if kind in ("Parameter", "FieldAccess"):
        own = f"{get('func')}.param[{get('param_idx', get('idx'))}]" if kind == "Parameter" else f"{get('type_name')}.{get('field')}"
        return f"{own} <- [{below}]" if below else own
    if kind == "ConfigKey":
        return f"config({get('key')}{', ' + get('file') if get('file') else ''})"
    if kind == "Flag":
        default = get("default_value")
        return f"flag({get('flag_name')}" + (f', default="{default}"' if default is not None else "") + ")"
    if kind == "ServiceDiscovery":
        return f"svc_discovery({get('service_name')}, {get('mechanism')})"
    return f"dynamic({get('hint')})" if get("hint") else "dynamic"


@F.pandas_udf(T.StringType())
def traced(trees: pd.Series) -> pd.Series:
    """Each tree as one line in the style of traces, long values cut; null for what is no JSON."""

    def line(text):
        try:
            return _shown(json.loads(text))
        except (TypeError, ValueError):
            return None

    return trees.map(line)


def first_variable(flat: Column) -> Column:
    """The first environment variable of a flattened tree, null without one."""
    return F.get(F.transform(F.filter(flat, lambda n: n["kind"] == "EnvVar"), lambda n: F.substring_index(n["text"], " ", 1)), F.lit(0))


def mentions(flat: Column, target: str) -> Column:
    return F.exists(flat, lambda n: F.contains(n["text"], F.lit(target)))


def classified(calls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """calls with the kinds and addresses that verdicts (file, line, net_kind, address_source) give: only a dynamic source without a hint is replaced."""
    v = verdicts.select("file", "line", F.col("net_kind").alias("v_kind"), F.col("address_source").alias("v_source"))
    empty = F.col("address_source").startswith('{"Dynamic"') & (F.coalesce(F.get_json_object("address_source", "$.Dynamic.hint"), F.lit("")) == "")
    met = calls.join(v, ["file", "line"], "left")
    told = F.col("v_kind").isNotNull()
    return met.withColumns(
        {
            "net_kind": F.coalesce("v_kind", "net_kind"),
            "address_source": F.when(empty & F.col("v_source").isNotNull(), F.col("v_source")).otherwise(F.col("address_source")),
            "confidence": F.when(told, "llm_classified").otherwise(F.col("confidence")),
        }
    ).select(calls.columns)


def cached(calls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts that the cache (file, line, callee, context_hash, net_kind, address_source) has for calls with context, and calls without one.

    A cached verdict holds as long as the call's context hashes alike.
    """
    keyed = calls.withColumn("context_hash", F.xxhash64("context"))
    key = ["file", "line", "callee", "context_hash"]
    return keyed.join(cache, key).select(*key, "net_kind", "address_source"), keyed.join(cache, key, "left_anti")


# ---- flows inside a file --------------------------------------------------------------------------------------------------------


def trace_back(uses: DataFrame, assignments: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Where the names that uses (use, file, at, name) read come from: use, depth, kind, value.

    assignments: file, at, name, kind (variable, literal, env, call, parameter), value. Each step takes the last assignment before the
    place of the read, and goes on from a variable; after max_depth steps a chain ends as dynamic.
    """
    spark = uses.sparkSession
    defs = stored(assignments.select("file", "name", F.col("at").alias("line"), F.monotonically_increasing_id().alias("id"), "kind", "value"), "assignments")
    level = stored(uses.select("use", "file", "name", (F.col("at") - 1).alias("line")), "uses")
    found = spark.createDataFrame([], "use bigint, depth int, kind string, value string")
    for depth in range(max_depth + 1):
        if level.isEmpty():
            break
        met = enclosing(level, defs.select("file", "name", "line", "id"), ("file", "name")).withColumnRenamed("definition", "id")
        step = met.select("use", "file", "name", "id").join(defs.select("id", F.col("line").alias("def_at"), "kind", "value"), "id", "left")
        step = stored(step, "trace")
        ends = step.where("kind is null or kind <> 'variable'").select("use", F.lit(depth).alias("depth"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("value", "name").alias("value"))
        found = found.unionByName(ends)
        level = step.where("kind = 'variable'").select("use", "file", F.col("value").alias("name"), (F.col("def_at") - 1).alias("line"))
        if depth == max_depth:
            found = found.unionByName(level.select("use", F.lit(depth).alias("depth"), F.lit("dynamic").alias("kind"), F.lit("depth-exceeded").alias("value")))
    return found
