"""Benchmark decontamination over a distributed positional inverted index.

build_index() stores the postings (term, doc, pos) of all words of all training documents; a benchmark is asked of it afterwards, and
another one needs no new pass over the texts. A term is the 64-bit hash of a word. The index is partitioned by document, as search engines
shard it, and sorted by term within each file: no posting list, however long, meets in one task, and lists compress to runs. A document's
length is the posting without a term, at its last position plus one.

Offset-adjusted lists are intersected from the rarest terms: of each window of an item the two rarest; a posting of the rarest at p, being
word q of the item, puts the item on the diagonal p - q, and the second must stand within the same SLOP neighbouring diagonals (on the same
one, for exact matches). On the diagonals left, the postings of all the item's words are looked up. WINDOW consecutive item words (all of
them, if the item has fewer) on one diagonal are an exact match, and such words on SLOP neighbouring diagonals, so with SLOP - 1 words put in
or left out among them, are a proximity match.

Two words that share a hash would be taken for one: among ten billion words and a million benchmark words that is one pair with a chance of
one in two thousand, and it changes a result only if the other words of a window stand around it.

Defined cases: null texts and texts without words have no postings and match nothing; repeated documents are matched each on its own;
repeated items count once by item_id; an item with a null item_id marks words but isn't counted; empty tables give empty results or
no match; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import ascii_lower, small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SLOP = 4
#: Ids of documents that are broadcast at most (16 MB of numbers).
BROADCAST_IDS = 2_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


class Index:
    """postings (term, doc, pos, doc_id) of a corpus, a stored table; doc_id stands in a document's last posting alone, the one without a term."""

    def __init__(self, postings: DataFrame):
        self.postings = postings

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(path))

    @property
    def lengths(self) -> DataFrame:
        """doc, doc_id and n_words of every document."""
        return self.postings.where("term is null").select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))

    @property
    def occurring(self) -> DataFrame:
        return self.postings.where("term is not null").select("term", "doc", "pos")


class Asked:
    """items (item, item_id, n) and places (item, q, term) of a benchmark, stored tables."""

    def __init__(self, benchmark: DataFrame):
        split = benchmark.select(F.monotonically_increasing_id().alias("item"), benchmark["item_id"].cast("string").alias("item_id"), words(benchmark["text"]).alias("words"))
        split = stored(split.where(F.size("words") > 0), "decontam-items")
        self.items = split.select("item", "item_id", F.size("words").alias("n"))
        self.places = stored(split.select("item", F.posexplode("words").alias("q", "word")).select("item", "q", F.xxhash64("word").alias("term")), "decontam-places")


def build_index(docs: DataFrame, path: str | None = None) -> Index:
    """The index of docs, stored at the path, or in the shared folder without one."""
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    terms = F.array_append(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), F.lit(None).cast("long"))
    lists = numbered.select("doc", "doc_id", F.posexplode(terms).alias("pos", "term"))
    postings = lists.select("term", "doc", "pos", F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id")).sortWithinPartitions("term", "doc", "pos")
    if path is None:
        return Index(stored(postings, "decontam-postings"))
    postings.write.parquet(path)
    return Index.opened(docs.sparkSession, path)


def probes(index: Index, asked: Asked, window: int = WINDOW) -> DataFrame:
    """item, (q1, t1) and (q2, t2): the two rarest terms of every window all of whose terms occur; windows that share them share a row."""
    sought = stored(asked.places.select("term").distinct(), "decontam-terms")
    counts = index.occurring.join(small(sought, sought.count()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_postings"))
    at = asked.places.join(asked.items, "item").join(counts, "term", "left")
    span = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - span + 1), F.least(F.col("q"), F.col("n") - span))
    by_window = (
        at.withColumn("start", F.explode(starts))
        .groupBy("item", "start")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n_postings", F.lit(0)).alias("n"), "q", "term"))).alias("rare"))  # window entries at most
        .where(F.col("rare")[0]["n"] > 0)
    )
    second = F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0])
    return by_window.select("item", F.col("rare")[0]["q"].alias("q1"), F.col("rare")[0]["term"].alias("t1"), second["q"].alias("q2"), second["term"].alias("t2")).distinct()


def diagonals(index: Index, asked: Asked, window: int = WINDOW, slop: int = 1) -> DataFrame:
    """item, doc and diagonal: those on which the rarest term of some window stands with the second within slop, and their neighbours within it."""
    probe = stored(probes(index, asked, window), "decontam-probes")
    n_probes = probe.count()
    first = index.occurring.join(small(probe, n_probes), F.col("term") == F.col("t1"))
    first = first.select("item", "doc", (F.col("pos") - F.col("q1")).alias("diagonal"), "t2", "q2")
    near = F.explode(F.sequence(F.lit(1 - slop), F.lit(slop - 1))) if slop > 1 else F.lit(0)
    first = first.withColumn("p2", near).withColumn("p2", F.col("p2") + F.col("diagonal") + F.col("q2"))
    seconds = probe.select(F.col("t2").alias("term")).distinct()
    second = index.occurring.join(small(seconds, n_probes), "term", "left_semi").select(F.col("doc").alias("s_doc"), F.col("pos").alias("s_pos"), F.col("term").alias("s_term"))
    met = first.join(second, (F.col("doc") == F.col("s_doc")) & (F.col("p2") == F.col("s_pos")) & (F.col("t2") == F.col("s_term")), "left_semi")
    met = met.select("item", "doc", "diagonal").distinct()
    return met.withColumn("by", near).select("item", "doc", (F.col("diagonal") + F.col("by")).alias("diagonal")).distinct() if slop > 1 else met


def found_words(index: Index, asked: Asked, window: int = WINDOW, slop: int = 1) -> DataFrame:
    """item, n, doc, diagonal, q, pos and run of every item word that stands on a candidate diagonal; run is the length of its run there."""
    on = stored(diagonals(index, asked, window, slop), "decontam-diagonals")
    candidates = on.select("doc").distinct()
    n_docs = candidates.count()
    occurring = index.occurring.join(small(candidates, n_docs, BROADCAST_IDS), "doc", "left_semi")
    sought = on.join(asked.places, "item").select("item", "doc", "diagonal", "q", (F.col("diagonal") + F.col("q")).alias("pos"), "term")
    met = sought.join(occurring, ["doc", "pos", "term"]).join(asked.items.select("item", "n"), "item")
    along = Window.partitionBy("item", "doc", "diagonal")
    ranked = met.withColumn("island", F.col("q") - F.row_number().over(along.orderBy("q")))
    return ranked.withColumn("run", F.count("*").over(Window.partitionBy("item", "doc", "diagonal", "island"))).drop("island", "term")


def _long_enough(window: int) -> Column:
    return F.col("run") >= F.least(F.col("n"), F.lit(window))


def phrases(index: Index, asked: Asked, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc, item, item_id, kind ('exact', or 'near' for an item without an exact match) and positions, the document's words that the match covers."""
    found = stored(found_words(index, asked, window, slop), "decontam-found")
    exact = found.where(_long_enough(window)).groupBy("item", "doc").agg(F.collect_set("pos").alias("positions"))
    band = F.explode(F.sequence(F.col("diagonal") - slop + 1, F.col("diagonal")))
    banded = found.join(exact.select("item", "doc"), ["item", "doc"], "left_anti").withColumn("band", band).select("item", "doc", "n", "band", "q", "pos")
    along = Window.partitionBy("item", "doc", "band")
    banded = banded.withColumn("island", F.col("q") - F.dense_rank().over(along.orderBy("q")))
    whole = Window.partitionBy("item", "doc", "band", "island")
    near = banded.withColumn("run", F.max("q").over(whole) - F.min("q").over(whole) + 1).where(_long_enough(window)).groupBy("item", "doc").agg(F.collect_set("pos").alias("positions"))
    both = exact.withColumn("kind", F.lit("exact")).unionByName(near.withColumn("kind", F.lit("near")))
    return both.join(asked.items.select("item", "item_id"), "item").select("doc", "item", "item_id", "kind", F.array_sort("positions").alias("positions"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, kind and n_covered, the words covered, of every exact and every proximity match."""
    index, asked = build_index(docs), Asked(benchmark)
    found = phrases(index, asked, window, slop)
    return found.join(index.lengths, "doc").select("doc_id", "item_id", "kind", F.size("positions").cast("long").alias("n_covered"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Of each row: doc_id, n_words, n_hit, n_items, item_ids (sorted) and contaminated: any hit, and one word in so many."""
    return contaminated(build_index(docs), Asked(benchmark), window, one_in)


def contaminated(index: Index, asked: Asked, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """contamination() of an index's documents."""
    exact = found_words(index, asked, window).where(_long_enough(window)).join(asked.items.select("item", "item_id"), "item")
    hits = exact.groupBy("doc").agg(F.countDistinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hits = hits.withColumnRenamed("doc", "hit_doc")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return index.lengths.join(hits, F.col("doc") == F.col("hit_doc"), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated")
    )
