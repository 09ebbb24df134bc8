"""Compaction: versions and tombstones that no reader can see any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oldest(snapshots: list[int], last: int) -> int:
    """The oldest sequence number that anyone may read at."""
    return min(snapshots) if snapshots else last + 1


def drop_shadowed(log: DataFrame, s: int) -> DataFrame:
    """A version goes if the next newer version of its key is visible at s. So all versions after s stay, and of the others each key's
    newest: an aggregate in parts, whatever a key's share of the versions."""
    newest = log.where(F.col("seq") <= s).groupBy("user_key").agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("v"))
    return log.where(F.col("seq") > s).select("user_key", "seq", "type", "value").unionByName(newest.select("user_key", "v.seq", "v.type", "v.value"))


def dead_tombstones(log: DataFrame, s: int, deeper: DataFrame | None = None) -> DataFrame:
    """Tombstones visible at s whose key no deeper file (smallest, largest) may hold."""
    dead = log.where((F.col("type") == 0) & (F.col("seq") <= s))
    return dead if deeper is None else dead.join(deeper, F.col("user_key").between(F.col("smallest"), F.col("largest")), "left_anti")


def compact(log: DataFrame, s: int, deeper: DataFrame | None = None) -> DataFrame:
    """The rows that stay: results of reads at s and after do not change."""
    kept = drop_shadowed(log, s)
    if deeper is None:
        return kept.where(~((F.col("type") == 0) & (F.col("seq") <= s)))
    return kept.join(dead_tombstones(kept, s, deeper).select("user_key", "seq"), ["user_key", "seq"], "left_anti")
