"""A corpus pipeline of five stages: quality rules, n-gram Jaccard join, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and reads again as the
next stage's docs. All but the last return the columns of docs, whatever others there are beside those of documents.

Decisions go by rows, not by doc_id: a row is known by the digest of its doc_id and text, and rows alike in both share their verdicts, as
none of the stages could tell them apart.

Defined cases: a row with a null doc_id is judged like any other, and of a group of similar rows one with a doc_id stays before one without;
rows that repeat a doc_id with other texts are judged each by its own text, and of rows that repeat both one stays after the second stage;
documents without words go in the first; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm import decontam, mixing, ngram_join, quality, sharding
from latticework.llm.common import small, stored, table

#: Words of a shingle and the similarity in per cent of the second stage; op10's contract values bind that query alone.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: Rows alike in all that the mix sees that one task numbers.
ALIKE_ROWS = 20_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return quality.passing(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _digest(docs: DataFrame) -> Column:
    return mixing.row_digest(docs, "row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that of the smallest doc_id, and of repeated rows one. Empty ones all stay."""
    in_order = F.struct(docs["doc_id"].isNull(), docs["doc_id"], _digest(docs).alias("digest"))
    found = ngram_join.similar_components(docs.select(in_order.alias("doc_id"), docs["text"].alias("text")), size=NEAR_SHINGLE, percent=NEAR_PERCENT)
    gone = found.where("key is not null and doc_id <> component_id").select(F.col("doc_id.digest").alias("_lw_gone")).distinct()
    gone = stored(gone, "pipeline-gone")
    return _once(docs.join(small(gone, gone.count()), _digest(docs) == F.col("_lw_gone"), "left_anti"))


def _once(docs: DataFrame) -> DataFrame:
    """docs with rows alike in doc_id and text once, if they have words."""
    worded = docs.where(docs["text"].rlike(mixing.WORD))
    repeated = worded.groupBy(_digest(worded).alias("_lw_again")).agg(F.count("*").alias("n")).where("n > 1").select("_lw_again")
    repeated = stored(repeated, "pipeline-repeated")
    n = repeated.count()
    if not n:
        return docs
    single = docs.join(small(repeated, n), _digest(docs) == F.col("_lw_again"), "left_anti")
    several = docs.join(small(repeated, n), _digest(docs) == F.col("_lw_again"))
    one = several.groupBy("_lw_again").agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias("_lw_row"))
    return single.unionByName(one.select("_lw_row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates."""
    found = decontam.contamination(docs.select(_digest(docs).alias("doc_id"), docs["text"].alias("text")), table(spark, sf_dir, "benchmark"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_lw_bad")).distinct(), "pipeline-bad")
    return docs.join(small(bad, bad.count()), _digest(docs) == F.col("_lw_bad"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows alike in doc_id, text and source have numbers of copies that differ by one at most, as the mix ends at one virtual time; the more
    are dealt out by a number that each of them is given.
    """
    plan = mixing.mixed(docs).groupBy(F.col("dig").alias("_lw_dig"), F.col("src").alias("_lw_src")).agg(F.count("*").alias("_lw_rows"), F.sum("copies").alias("_lw_all"))
    plan = plan.where("_lw_all > 0").select("_lw_dig", "_lw_src", "_lw_rows", F.expr("_lw_all div _lw_rows").alias("_lw_each"), F.expr("_lw_all % _lw_rows").alias("_lw_more"))
    plan = stored(plan, "pipeline-mix")
    alike = (mixing.row_digest(docs) == F.col("_lw_dig")) & docs["source"].eqNullSafe(F.col("_lw_src"))
    even, uneven = plan.where("_lw_more = 0"), plan.where("_lw_more > 0")
    taken = docs.join(small(even, even.count()), alike).withColumn("_lw_copies", F.col("_lw_each"))
    out = _copied(taken, docs.columns)
    n = uneven.count()
    if n:
        rows = docs.join(small(uneven, n), alike)
        rows = stored(rows.withColumn("_lw_row", F.monotonically_increasing_id()), "pipeline-alike")
        rows = rows.withColumn("_lw_part", F.pmod(F.xxhash64("_lw_row"), F.ceil(F.col("_lw_rows") / ALIKE_ROWS)))
        group = ["_lw_dig", "_lw_src"]
        counts = rows.groupBy(*group, "_lw_part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("_lw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select(*(F.col(c).alias(f"{c}_at") for c in (*group, "_lw_part")), before.alias("_lw_start"))
        met = (F.col("_lw_dig") == F.col("_lw_dig_at")) & F.col("_lw_src").eqNullSafe(F.col("_lw_src_at")) & (F.col("_lw_part") == F.col("_lw_part_at"))
        number = F.col("_lw_start") + F.row_number().over(Window.partitionBy(*group, "_lw_part").orderBy("_lw_row"))
        numbered = rows.join(starts, met).withColumn("_lw_copies", F.col("_lw_each") + (number <= F.col("_lw_more")).cast("long"))
        out = out.unionByName(_copied(numbered.where("_lw_copies > 0"), docs.columns))
    return out


def _copied(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("_lw_copy", F.explode(F.expr("sequence(1L, _lw_copies)"))).select(*columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    return sharding.shard(docs, shards=8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]

#: SQL can express neither the hashes of the first stage nor the last stage's; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
