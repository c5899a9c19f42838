"""Files as lines, and what can be told by lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 15, 14


def lines_of(files: DataFrame, keep: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """keep, line (from 1) and text of files with content."""
    kept = [c for c in keep if c in files.columns]
    return files.select(*kept, F.posexplode(F.split("content", r"\r?\n")).alias("at", "text")).select(*kept, (F.col("at") + 1).alias("line"), "text")


def context(lines: DataFrame, sites: DataFrame, by: tuple[str, ...] = ("file",), before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """sites (by, line) with lines, the (line, text) from so many before to so many after, in order.

    A range join by blocks as wide as the range: a site meets the lines of two or three blocks, and no other pair is made.
    """
    width = before + after + 1
    keys = list(by)
    blocks = F.sequence(F.floor((F.col("line") - before) / width), F.floor((F.col("line") + after) / width))
    wide = sites.select(*keys, "line", F.explode(blocks).alias("block"))
    near = lines.select(*keys, F.col("line").alias("at"), "text", F.floor(F.col("line") / width).alias("block"))
    met = wide.join(near, [*keys, "block"]).where(F.col("at").between(F.col("line") - before, F.col("line") + after))
    return met.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("line"), "text"))).alias("lines"))


def indent(text: Column) -> Column:
    return F.length(text) - F.length(F.ltrim(text))


def yaml_field(text: Column, field: str) -> Column:
    """The value of ``field:`` on a line, a list's dash before it allowed; null on other lines, empty without a value."""
    pattern = rf"^\s*(?:-\s+)?{field}:\s*(.*?)\s*$"
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+#.*$", ""), r"""^["']|["']$""", ""))
