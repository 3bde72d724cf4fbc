"""Snapshots of a tree: hashes, differences, and new snapshots from old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes or text, in hex."""
    return F.sha2(content, 256)


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """path, change_type, old_hash, new_hash for each path in either snapshot (path, hash)."""
    a = new.select("path", F.col("hash").alias("new_hash"))
    b = old.select("path", F.col("hash").alias("old_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", kind.alias("change_type"), "old_hash", "new_hash")


def deleted(new: DataFrame, old: DataFrame) -> DataFrame:
    return old.select("path").join(new.select("path"), "path", "left_anti")


def summary(changes: DataFrame) -> DataFrame:
    """One row: files of each change type, all of them, and whether anything changed."""
    count = lambda k: F.count_if(F.col("change_type") == k)
    return changes.agg(
        count("added").alias("added"), count("modified").alias("modified"), count("deleted").alias("deleted"), count("unchanged").alias("unchanged"),
        F.count("*").alias("total_files"), (F.count_if(F.col("change_type") != "unchanged") > 0).alias("has_changes"),
    )


def upsert(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    """snapshot with rows put in place of those of the same path."""
    return snapshot.join(rows.select("path"), "path", "left_anti").select(*snapshot.columns).unionByName(rows.select(*snapshot.columns))


def remove(snapshot: DataFrame, paths: DataFrame) -> DataFrame:
    return snapshot.join(paths.select("path"), "path", "left_anti")


def apply(changes: DataFrame) -> DataFrame:
    """The new snapshot: every change row that isn't a deletion."""
    return changes.where("change_type <> 'deleted'")
