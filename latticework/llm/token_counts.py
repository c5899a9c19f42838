"""Token counts by an exact length histogram.

Documents are aggregated by (group, encoded length), and suffix sums over the histogram then answer, for every context limit, how many
documents are longer, how many tokens there are, and how many remain when each document is cut at the limit. The histogram has a row for
each length that occurs, however many documents there are; its running sums are taken within spans of lengths and then over the spans.

Defined cases: a null text counts as empty (length 0); repeated rows count each; a null group is a group; an empty table has an empty
histogram; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import stored
from latticework.llm.encoding import BATCH, encoder, texts_of

#: Lengths in a span of the histogram.
SPAN = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source and n_tokens of each row."""
    schema = T.StructType([*docs.select("doc_id", "source").schema, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                counts = pa.array(code.lengths(texts_of(batch, 2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def histogram(counted: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """The groups, n_tokens and n_docs."""
    return counted.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def with_sums(hist: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """A row for each (group, limit) with limit a length that occurs: n_docs of it; docs_over and tokens_over, of longer documents;
    docs and tokens of the group; docs_up_to; and tokens_cut, what remains if every document is cut at the limit."""
    rows = hist.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    rows = stored(rows, "length-histogram")
    spans = rows.groupBy(*by, "span").agg(F.sum("n_docs").alias("s_docs"), F.sum("mass").alias("s_mass"))
    above = Window.partitionBy(*by).orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    all_of = Window.partitionBy(*by)
    zero = F.lit(0)
    spans = spans.select(
        *(F.col(c).alias(f"g_{c}") for c in by),
        F.col("span").alias("g_span"),
        F.coalesce(F.sum("s_docs").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("s_mass").over(above), zero).alias("mass_above"),
        F.sum("s_docs").over(all_of).alias("docs"),
        F.sum("s_mass").over(all_of).alias("tokens"),
    )
    same = F.col("span") == F.col("g_span")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"g_{c}"))
    longer = Window.partitionBy(*by, "span").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    out = (
        rows.join(spans, same)
        .withColumn("docs_over", F.col("docs_above") + F.coalesce(F.sum("n_docs").over(longer), zero))
        .withColumn("tokens_over", F.col("mass_above") + F.coalesce(F.sum("mass").over(longer), zero))
    )
    cut = F.col("tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    return out.select(*by, F.col("n_tokens").alias("limit"), "n_docs", "docs_over", "tokens_over", "docs", "tokens", (F.col("docs") - F.col("docs_over")).alias("docs_up_to"), cut.alias("tokens_cut"))


def quantiles(sums: DataFrame, per_mille: Sequence[int], by: Sequence[str] = ("source",)) -> DataFrame:
    """The groups, q (per mille) and length: the least length that so many documents don't exceed."""
    asked = sums.withColumn("q", F.explode(F.array(*map(F.lit, per_mille))))
    reached = asked.where(1000 * F.col("docs_up_to") >= F.col("q") * F.col("docs"))
    return reached.groupBy(*by, "q").agg(F.min("limit").alias("length"))


def truncated(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ("source",)) -> DataFrame:
    """For any context limits: docs, tokens, docs_over and tokens_cut of each group, from the longest length up to the limit."""
    asked = sums.withColumn("asked", F.explode(F.array(*map(F.lit, limits))))
    at = asked.where(F.col("limit") <= F.col("asked")).groupBy(*by, "asked").agg(F.max_by(F.struct("limit", "tokens_cut", "docs_over"), "limit").alias("at"))
    every = sums.groupBy(*by).agg(F.first("docs").alias("docs"), F.first("tokens").alias("tokens"), F.min("limit").alias("least")).withColumn("asked", F.explode(F.array(*map(F.lit, limits))))
    same = every["asked"] == at["asked"]
    for c in by:
        same &= every[c].eqNullSafe(at[c])
    joined = every.join(at, same, "left")
    over = F.coalesce("at.docs_over", "docs")
    cut = F.coalesce(F.col("at.tokens_cut") + (every["asked"] - F.col("at.limit")) * F.col("at.docs_over"), every["asked"] * F.col("docs"))
    return joined.select(*(every[c].alias(c) for c in by), every["asked"].alias("limit"), "docs", "tokens", over.alias("docs_over"), cut.alias("tokens_cut"))
