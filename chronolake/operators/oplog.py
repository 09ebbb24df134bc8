"""Making operation logs: from tables, from batches of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, PUT


def changelog(df: DataFrame, key: Column, seq: Column, deleted: Column, value: Column) -> DataFrame:
    """(user_key, seq, type, value) of a table whose rows are operations; a tombstone has no value."""
    return df.select(key.cast("string").alias("user_key"), seq.cast("long").alias("seq"), F.when(deleted, DELETE).otherwise(PUT).alias("type"), F.when(~deleted, value).alias("value"))


def batches(ops: DataFrame, base: int, size: int) -> DataFrame:
    """Operations with op_idx, in atomic batches of `size`: sequence numbers are consecutive from base, in op order."""
    return ops.withColumn("batch_id", F.floor(F.col("op_idx") / size).cast("long")).withColumn("seq", F.lit(base) + F.col("op_idx"))


def batch_summary(log: DataFrame, size: int) -> DataFrame:
    """What a batch's header says: first sequence number and count, with puts and deletes."""
    by = F.floor((F.col("seq") - 1) / size).cast("long").alias("batch_id")
    return log.groupBy(by).agg(F.min("seq").alias("sequence"), F.count("*").alias("cnt"), F.sum(F.col("type").cast("long")).alias("puts"), F.sum((1 - F.col("type")).cast("long")).alias("deletes"))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """One batch after another: the second's operations are renumbered to follow the first's last, kept in their own order and gaps."""
    last, least = first.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar(), second.agg(F.coalesce(F.min("seq"), F.lit(1))).scalar()
    return first.unionByName(second.withColumn("seq", F.col("seq") - least + last + 1))


def replay(*parts: DataFrame) -> DataFrame:
    """Logged batches applied again: an operation that was logged twice counts once."""
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return log.dropDuplicates(["user_key", "seq"])
