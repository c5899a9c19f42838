"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import storage
from latticework.storage import new_dir, small, stored

__all__ = ["ascii_lower", "digest_bucket", "give_back", "joined_by", "lowest", "new_dir", "small", "stored", "table"]

#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = storage.BROADCAST_ROWS
#: A key of more rows than this is joined by broadcast, if there are HOT_KEYS of such keys at most; else one of more than their share.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns memory that a worker no longer needs to the system: workers stay when their tasks are done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def lowest(df: DataFrame, hashed: str, limit: int) -> DataFrame:
    """The rows of the lowest hashes (a column of xxhash64), limit at most.

    Of many rows only those below about twice the share asked for are sorted, so no task gets limit rows from every partition.
    """
    rows = df.count()
    if rows > 4 * limit:
        df = df.where(F.col(hashed) < -(1 << 63) + (2 * limit << 64) // rows)
    return df.orderBy(hashed).limit(limit)


def joined_by(left: DataFrame, right: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """left with found: a struct of right's other columns for its key, null without any.

    right has a row for each key and n, how many rows of left have it; rows: all rows of left; most: a bound of right's rows. Beyond a
    broadcast of all, only keys of many rows are broadcast, HOT_KEYS of them at most, and the others joined by shuffle.
    """
    other = F.struct(*(c for c in right.columns if c not in (key, "n"))).alias("found")
    if most <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.select(key, other)), key, "left")
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    hot = F.broadcast(right.where(F.col("n") > limit).select(key, other))
    cold = right.where(F.col("n") <= limit).select(key, other)
    often = left.join(hot, key)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return often.unionByName(rest)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest_bucket(digest: Column, buckets: Column) -> Column:
    """The bucket of a hex digest, of so many of about even size that lie on the digests' line in order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long")
