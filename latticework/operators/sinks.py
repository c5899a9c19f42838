"""Telling network calls by rules: the user's first, then the built-in registry, then names, then what merely may be one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import classify
from latticework.operators import registry_table
from latticework.storage import small

CUSTOM = "pos int, fqn string, category string, addr_arg int, direction string"
REGISTRY = "fqn string, category string, addr_arg int, direction string"

ROUTES = "fqn string, pattern_arg int, handler_arg int"


def builtin(spark: SparkSession) -> DataFrame:
    """REGISTRY rows of the built-in libraries. Any table of REGISTRY, such as one read from a file, can take its place."""
    rows = [row[1:] for row in registry_table.sink_rows(classify.INBOUND_KINDS)]
    return spark.createDataFrame(rows, REGISTRY)


def builtin_routes(spark: SparkSession) -> DataFrame:
    """ROUTES rows of the built-in calls that register routes."""
    return spark.createDataFrame(registry_table.route_rows(), ROUTES)


def route_calls(calls: DataFrame, imports: DataFrame, routes: DataFrame) -> DataFrame:
    """id, pattern_arg and handler_arg of the calls (as told() takes them) that register a route."""
    met = candidates(calls, imports).join(F.broadcast(routes), F.col("candidate") == F.col("fqn"))  # a fixed table
    return met.groupBy("id").agg(F.min(F.struct("turn", "pattern_arg", "handler_arg")).alias("best")).select("id", "best.pattern_arg", "best.handler_arg")


def candidates(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (id, file, receiver, callee) with candidate (a full name) and turn, the order in which candidates count.

    imports: file, path, alias. A receiver that is an import's alias stands for its path; without one the names stand for themselves.
    """
    dotted = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), ".")
    head = F.substring_index("receiver", ".", 1)
    met = calls.withColumn("head", head).join(imports.select("file", F.col("alias").alias("head"), "path").distinct(), ["file", "head"], "left")
    rest = F.substring(F.col("receiver"), F.length("head") + 2, F.length("receiver"))
    by_import = F.when(F.col("path").isNotNull(), dotted(F.col("path"), rest, F.col("callee")))
    last = F.when(F.col("path").isNotNull(), dotted(F.substring_index("path", "/", -1), rest, F.col("callee")))
    names = F.array(by_import, last, dotted(F.col("receiver"), F.col("callee")), F.col("callee"))
    return met.select(*calls.columns, F.posexplode(names).alias("turn", "candidate")).where("candidate is not null")


def by_registry(named: DataFrame, registry: DataFrame) -> DataFrame:
    """id, category, addr_arg and direction: of each call's candidates the first that the registry has."""
    met = named.join(F.broadcast(registry), F.col("candidate") == F.col("fqn"))  # a fixed registry of a few hundred rules
    best = met.groupBy("id").agg(F.min(F.struct("turn", "category", "addr_arg", "direction")).alias("best"))
    return best.select("id", "best.category", "best.addr_arg", "best.direction")


def by_custom(named: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by the user's rules (CUSTOM): equal names, or one that ends the other behind ``/`` or ``.``; the first rule counts.

    All endings of a candidate and of a rule at such a sign are listed, and joined where one is whole: no pair is tried in vain.
    """

    def endings(c):
        cuts = F.filter(F.sequence(F.lit(1), F.length(c)), lambda k: (k == 1) | F.substring(c, k - 1, F.lit(1)).isin("/", "."))
        return F.transform(cuts, lambda k: F.substring(c, k, F.length(c)))

    n = rules.count()
    left = named.select("id", "candidate", F.explode(endings(F.col("candidate"))).alias("tail"))
    right = rules.select("pos", "fqn", "category", "addr_arg", "direction", F.explode(endings(F.col("fqn"))).alias("tail"))
    met = left.join(small(right, n * 10), "tail").where((F.col("tail") == F.col("candidate")) | (F.col("tail") == F.col("fqn")))
    best = met.groupBy("id").agg(F.min(F.struct("pos", "category", "addr_arg", "direction")).alias("best"))
    return best.select("id", "best.category", "best.addr_arg", "best.direction")


def told(calls: DataFrame, imports: DataFrame, registry: DataFrame, rules: DataFrame) -> DataFrame:
    """calls (id, file, receiver, callee, first_arg) that are network calls, with category, direction, addr_arg and how they were told."""
    named = candidates(calls, imports)
    paths = imports.groupBy("file", "alias").agg(F.collect_set("path").alias("paths"))
    custom, known = (df.select("id", F.struct("category", "addr_arg", "direction").alias(name)) for df, name in ((by_custom(named, rules), "custom"), (by_registry(named, registry), "known")))
    head = F.substring_index("receiver", ".", 1)
    rows = calls.withColumn("alias", head).join(paths, ["file", "alias"], "left").join(custom, "id", "left").join(known, "id", "left")
    guess = classify.call_kind(F.coalesce("receiver", F.lit("")), F.col("callee"), F.coalesce("first_arg", F.lit("")))
    maybe = classify.may_be_network(F.coalesce("receiver", F.lit("")), F.col("callee"), F.coalesce("first_arg", F.lit("")), F.coalesce("paths", F.array().cast("array<string>")))
    how = F.when(F.col("custom").isNotNull(), "custom").when(F.col("known").isNotNull(), "registry").when(F.col("guess").isNotNull(), "heuristic").when(F.col("maybe"), "permissive")
    rows = rows.withColumn("guess", guess).withColumn("maybe", maybe).withColumn("how", how).where("how is not null")
    category = F.coalesce("custom.category", "known.category", "guess", F.lit("unknown"))
    return rows.select(
        *calls.columns,
        category.alias("category"),
        F.coalesce("custom.direction", "known.direction", classify.direction(category)).alias("direction"),
        F.coalesce("custom.addr_arg", "known.addr_arg", F.lit(0)).alias("addr_arg"),
        "how",
        F.when(F.col("how").isin("custom", "registry"), "import_resolved").otherwise("heuristic").alias("confidence"),
    )
