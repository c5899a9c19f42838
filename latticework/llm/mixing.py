"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has sent through it, over the source's target.
Sorted by that time, all sources advance in proportion to their targets, and the mix is the prefix that fits the budget.

The two running sums are taken in buckets (of the shuffle digest within a source, and of the finish time over all), so no
source and no stretch of the schedule lands in one task, however many of the rows it holds. Rows that are alike in doc_id, text and source
are counted first and then numbered, and all but the first take a digest of their own by that number, so they spread like any others.

Defined cases: a null text has size 0; null is a source of its own, after all others; documents of size 0 are no part of the schedule and
taken 0 times; repeated rows are scheduled each on its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import digest_bucket, small, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a bucket, about.
PER_BUCKET = 500
#: Rows that are alike and are numbered by one task at once.
CHUNK = 10_000
SEED = "mix"


def row_digest(docs: DataFrame, seed: str = SEED) -> Column:
    """The shuffle digest of a row: of its doc_id and its text."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.lit(":"), F.md5(text)))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """src, dig, doc_id, size and rows, the number of rows of docs that are alike in them."""
    text = F.coalesce(docs["text"], F.lit(""))
    each = docs.select(
        docs["source"].alias("src"),
        row_digest(docs, seed).alias("dig"),
        docs["doc_id"].alias("doc_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    return each.groupBy("src", "dig", "doc_id", "size").agg(F.count("*").alias("rows"))


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with its rows one by one: which is 0 for the first of those alike, and each has a digest of its own, spread."""
    first = sizes.drop("rows").withColumns({"which": F.lit(0).cast("long"), "spread": F.col("dig")})
    more = sizes.where("rows > 1").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (rows - 2) div {CHUNK})")))
    more = more.repartition("dig", "chunk").withColumn("which", F.explode(F.expr(f"sequence(chunk * {CHUNK} + 1, least((chunk + 1) * {CHUNK}, rows - 1))")))
    more = more.drop("rows", "chunk").withColumn("spread", F.md5(F.concat(F.col("dig"), F.lit(":"), F.col("which").cast("string"))))
    return first.unionByName(more)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Of each source in sizes (src, size, rows): src, n_docs, source_size, budget, target.

    Sources in code-point order, null last, weigh as the weights repeat. They share the budget (share of all sizes); no target is
    above max_epochs times its source's size, and what is cut there goes to the others by weight. In closed form: by ascending
    ratio of cap to weight, a source is capped while its cap is within its share of what the capped ones before it have left.
    """
    order = Window.orderBy(F.col("src").isNull(), "src")
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    by_src = sizes.groupBy("src").agg(F.sum("rows").alias("n_docs"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    every = Window.partitionBy()
    by_cap = Window.orderBy("ratio", F.col("src").isNull(), "src")
    ranked = (
        by_src.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.coalesce("capped", F.lit(0))) / F.col("open_weight"))
        .withColumn("rank", F.row_number().over(by_cap))
        .withColumn("first_open", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("rank", "level"))).over(every))
    )
    is_open = F.col("first_open").isNotNull() & (F.col("rank") >= F.col("first_open.rank"))
    target = F.when(is_open, F.least(F.col("cap").cast("double"), F.col("first_open.level") * F.col("weight"))).otherwise(F.col("cap").cast("double"))
    return ranked.select("src", "n_docs", "source_size", "budget", target.alias("target"))


def finish_bucket(finish: Column, buckets: int) -> Column:
    """A monotone bucket of the finish time: even up to 2, in octaves beyond, where only sources far above their target have copies."""
    return F.when(finish < 2, F.floor(finish * buckets)).otherwise(F.lit(2 * buckets) + F.floor(F.log2(finish / 2) * buckets)).cast("long")


def _schedule(sizes: DataFrame, targets: DataFrame, max_epochs: int) -> DataFrame:
    n_sources, rows = targets.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    t = targets.select(F.col("src").alias("t_src"), "source_size", "budget", "target", F.ceil(F.col("n_docs") / PER_BUCKET).alias("buckets"))
    each = numbered(sizes.where("size > 0"))
    rows_at = each.join(small(t, n_sources), each["src"].eqNullSafe(t["t_src"])).drop("t_src").withColumn("bucket", digest_bucket(F.col("spread"), F.col("buckets")))
    rows_at = stored(rows_at.drop("buckets"), "mix-rows")
    sums = rows_at.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("spread", "doc_id", "size", "which")
    placed = (
        rows_at.join(starts, rows_at["src"].eqNullSafe(starts["b_src"]) & (rows_at["bucket"] == starts["b_bucket"]))
        .drop("b_src", "b_bucket")
        .withColumn("place", F.row_number().over(inside))
        .withColumn("through", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    slices = max(16, -(-rows // PER_BUCKET))
    copies = (
        placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs))))
        .withColumn("finish", (F.col("through") + (F.col("epoch") - 1) * F.col("source_size")) / F.col("target"))
        .withColumn("slice", finish_bucket(F.col("finish"), slices))
        .select("src", "bucket", "place", "dig", "doc_id", "size", "source_size", "budget", "target", "epoch", "finish", "slice")
    )
    copies = stored(copies, "mix-copies")
    by_slice = copies.groupBy("slice").agg(F.sum("size").alias("in_slice"))
    through = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # three numbers for each PER_BUCKET rows
    bases = by_slice.select(F.col("slice").alias("s_slice"), F.coalesce(F.sum("in_slice").over(through), F.lit(0)).alias("s_base"))
    in_order = Window.partitionBy("slice").orderBy("finish", F.col("src").isNull(), "src", "place", "bucket", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    return (
        copies.join(bases, copies["slice"] == bases["s_slice"])
        .withColumn("position", F.col("s_base") + F.sum("size").over(in_order))
        .withColumn("kept", F.col("position") <= F.col("budget"))
        .drop("s_slice", "s_base", "slice", "budget")
    )


def _measured(docs: DataFrame, weights: Sequence[int], max_epochs: int, share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    sizes = stored(sized(docs, seed), "mix-sizes")
    return sizes, stored(source_targets(sizes, weights, max_epochs, share), "mix-targets")


def schedule(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every possible copy of every document that has words, with its place in the mix.

    Columns: src, bucket, place (together a row's key), dig, doc_id, size, source_size, target, epoch, finish, position (words of the
    mix through this copy) and kept (within the budget). Sorted by (finish, src, place) kept copies are the mix's order.
    """
    return _schedule(*_measured(docs, weights, max_epochs, share, seed), max_epochs)


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """One row per document: dig (row_digest()), doc_id, src, size, source_size, target, copies and taken, the words that the mix takes of it."""
    sizes, targets = _measured(docs, weights, max_epochs, share, seed)
    plan = _schedule(sizes, targets, max_epochs)
    columns = ["dig", "doc_id", "size", "source_size", "target"]
    copies = F.sum(F.col("kept").cast("long"))
    taken = plan.groupBy("src", "bucket", "place").agg(*(F.first(c).alias(c) for c in columns), copies.alias("copies")).drop("bucket", "place")
    t = targets.select(F.col("src").alias("t_src"), "source_size", "target")
    blank = numbered(sizes.where("size = 0"))
    blank = blank.join(small(t, targets.count()), blank["src"].eqNullSafe(t["t_src"])).withColumn("copies", F.lit(0).cast("long"))
    rows = taken.select("src", *columns, "copies").unionByName(blank.select("src", *columns, "copies"))
    return rows.select("dig", "doc_id", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
