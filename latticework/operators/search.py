"""Searching names: trigrams, substrings, globs and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import predicates
from latticework.model import NodeKind
from latticework.operators.matching import enclosing


def byte_trigrams(text: Column) -> Column:
    """The distinct trigrams of a name's bytes, ASCII letters in lower case, as hexadecimal digits."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digits = F.hex(F.encode(low, "UTF-8"))
    return F.when(F.length(digits) >= 6, F.array_distinct(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 3).cast("int")), lambda k: F.substring(digits, k * 2 + 1, F.lit(6))))).otherwise(
        F.array().cast("array<string>")
    )


def _grams_of(query: str) -> list[str]:
    data = query.encode().lower()  # of bytes: ASCII letters
    return list(dict.fromkeys(data[k : k + 3].hex().upper() for k in range(len(data) - 2)))


def trigram_index(names: DataFrame) -> DataFrame:
    """gram and id: the postings of names (id, name)."""
    return names.select(F.explode(byte_trigrams(F.col("name"))).alias("gram"), "id")


def trigram_search(names: DataFrame, query: str, most: int = 20, index: DataFrame | None = None) -> DataFrame:
    """id, name, quality (3 equal, 2 a beginning, 1 else), hits: the best of names that share a quarter of the query's trigrams at least.

    Without three bytes to search for, names that hold the query, by id. Given a stored index, only the postings of the query's trigrams
    are read, and names only for what they leave.
    """
    grams = _grams_of(query)
    low = F.lower("name")
    if not grams:
        found = names.where(F.contains(low, F.lit(query.lower()))).select("id", "name", F.lit(1).alias("quality"), F.lit(0).cast("long").alias("hits"))
        return found.orderBy("id").limit(most)
    least = max(1, len(grams) // 4)
    if index is None:
        wanted = F.array(*map(F.lit, grams))
        counted = names.withColumn("hits", F.size(F.array_intersect(byte_trigrams(F.col("name")), wanted)).cast("long")).where(F.col("hits") >= least)
    else:
        ids = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
        counted = names.join(ids, "id")
    quality = F.when(low == query.lower(), 3).when(low.startswith(query.lower()), 2).otherwise(1)
    ranked = counted.select("id", "name", quality.alias("quality"), "hits")
    return ranked.orderBy(F.desc("quality"), F.desc("hits"), F.length("name"), "name", "id").limit(most)


def suggestions(nodes: DataFrame, wanted: str, most: int = 5) -> DataFrame:
    """The first nodes whose names hold the wanted text."""
    return nodes.where(F.contains(F.lower("name"), F.lit(wanted.lower()))).select("id", "name").orderBy("id").limit(most)


def resolve_target(nodes: DataFrame, target: str, calls: DataFrame | None = None) -> DataFrame:
    """id and how: the nodes that a target names, by the first way that finds any.

    ``env:GLOB`` names resources, ``file:line`` the symbol around a line, ``call:file:name`` a symbol in a file; else an exact name, the
    callee of a known call, or an address that a call mentions.
    """
    kind, _, rest = target.partition(":")
    symbols = nodes.where(F.col("kind") == int(NodeKind.SYMBOL))
    named = lambda df, how: df.select("id", F.lit(how).alias("how"))
    ways = []
    if kind == "env":
        ways.append(named(nodes.where((F.col("kind") == int(NodeKind.RESOURCE)) & predicates.glob(F.col("name"), rest)), "env"))
    elif kind == "call" and ":" in rest:
        file, _, name = rest.rpartition(":")
        ways.append(named(symbols.where((F.col("name") == name) & F.col("file").endswith(file)), "call"))
    elif rest.isdigit():
        site = nodes.sparkSession.createDataFrame([(kind, int(rest))], "file string, line int")
        ways.append(enclosing(site, symbols.select("file", "line", "id")).where("definition is not null").select(F.col("definition").alias("id"), F.lit("line").alias("how")))
    ways.append(named(nodes.where(F.col("name") == target).orderBy("id").limit(1), "name"))
    if calls is not None:
        for how, test in (("callee", F.col("callee_fqn").endswith(target)), ("address", F.contains("address_source", F.lit(target)))):
            at = calls.where(test).select("file", "line").distinct()
            ways.append(enclosing(at, symbols.select("file", "line", "id")).where("definition is not null").select(F.col("definition").alias("id"), F.lit(how).alias("how")).distinct())
    for way in ways:
        if not way.isEmpty():
            return way
    return ways[0].limit(0)
