"""What a series of snapshots tells: the changes of each, and since when something has been there.

Snapshots are rows with ``snapshot``, numbers that run without gaps, over the columns of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _present(snapshots: DataFrame, key: list[str]) -> DataFrame:
    return snapshots.select("snapshot", *key).distinct()


def log(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """snapshot, key and change: what each snapshot added to and removed from the one before. The first adds all it has.

    A snapshot is compared with the one before by an anti-join on the key and the number, so all are compared at once.
    """
    here = _present(snapshots, key)
    before = here.withColumn("snapshot", F.col("snapshot") + 1)
    added = here.join(before, ["snapshot", *key], "left_anti").withColumn("change", F.lit("added"))
    gone = before.join(here, ["snapshot", *key], "left_anti")
    last = here.agg(F.max("snapshot").alias("last"))
    removed = gone.join(F.broadcast(last), F.col("snapshot") <= F.col("last")).drop("last").withColumn("change", F.lit("removed"))  # last: one row
    return added.unionByName(removed)


def log_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("snapshot", "change").agg(F.count("*").alias("n"))


def blame(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """key and since: for what the last snapshot has, the snapshot that added it for the last time."""
    here = _present(snapshots, key)
    last = here.agg(F.max("snapshot").alias("snapshot"))
    current = here.join(F.broadcast(last), "snapshot", "left_semi").select(*key)  # last: one row
    added = log(snapshots, key).where("change = 'added'").groupBy(*key).agg(F.max("snapshot").alias("since"))
    return added.join(current, key, "left_semi")
