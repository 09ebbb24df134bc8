"""Reads of an operation log: newest versions, snapshots, lookups, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import PUT
from ..shared import written


def versions(log: DataFrame, at: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones too, at a snapshot: partly aggregated before the only shuffle, so a hot key is no burden."""
    if at is not None:
        log = log.where(F.col("seq") <= at)
    newest = log.groupBy("user_key").agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("v"))
    return newest.select("user_key", "v.seq", "v.type", "v.value")


def latest(log: DataFrame, at: int | None = None) -> DataFrame:
    """(user_key, seq, value) of live keys. Tombstones are dropped after the newest version is known, never before."""
    return versions(log, at).where(F.col("type") == PUT).drop("type")


def get(log: DataFrame, key: str, at: int | None = None) -> DataFrame:
    """One key: the filter reaches the scan."""
    return latest(log.where(F.col("user_key") == key), at)


def as_of(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """(user_key, s, seq, value) at each of a few snapshots, in one pass."""
    seen = log.withColumn("s", F.explode(F.filter(F.array(*[F.lit(s).cast("long") for s in snapshots]), lambda s: s >= F.col("seq"))))
    newest = seen.groupBy("user_key", "s").agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("v"))
    return newest.where(F.col("v.type") == PUT).select("user_key", "s", "v.seq", "v.value")


def multi_get(log: DataFrame, keys: DataFrame, at: int | None = None) -> DataFrame:
    """Many keys at once: (user_key, found, value) for each row of keys. Only asked keys are aggregated."""
    asked = latest(log.join(keys.select("user_key").distinct(), "user_key", "left_semi"), at)
    return keys.join(asked, "user_key", "left").select("user_key", F.col("seq").isNotNull().alias("found"), "value")


def scan_anti(log: DataFrame) -> DataFrame:
    """Live keys by anti-join: the largest sequence number of each key whose newest operation is no delete."""
    newest = log.groupBy("user_key").agg(F.max("seq").alias("seq"))
    return newest.join(log.where("type = 0").select("user_key", "seq"), ["user_key", "seq"], "left_anti")


def intervals(log: DataFrame) -> DataFrame:
    """Validity of versions: [seq, next seq of the key), in the log's global order, so that a hot key's versions lie in many ranges."""
    own = log.select("user_key", "seq", "type", F.struct("user_key", "seq").alias("_own"))
    rows = adjacent(own, [F.col("user_key"), F.col("seq")], "_own")
    return rows.select("user_key", F.col("seq").alias("valid_from"), F.when(F.col("next.user_key") == F.col("user_key"), F.col("next.seq")).alias("valid_to"), "type")


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in a total order, written once to the shared folder, with _p (the range a row is in) and _i (its place there, from 0).

    Whatever is counted by range and joined to the rows of the range must come from the same ranges. Two plans of one range exchange may
    sample different bounds, so the rows are written, and all that follows reads that one table. Range and place are taken as the sorted
    partition passes by: one shuffle, and no window over a partition.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(spread)
    return kept.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """pos: the place of each row in the global order, from 1: its place in its range and the counts of the ranges before. The order must
    be total; an empty table gives no rows."""
    return _placed(ordered(df, order)).drop("_p", "_i")


def _placed(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a range
    return rows.join(F.broadcast(before), "_p").withColumn("pos", F.col("_before") + F.col("_i") + 1).drop("_before")


def running_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """df with each value replaced by its running sum in the order, own row included: summed within ranges and offset by the sums of the
    ranges before, so no task holds the table. Where rows tie, their order among each other is any."""
    rows = ordered(df, order)
    sums = rows.groupBy("_p").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = sums.select("_p", *[(F.sum(f"_{v}").over(Window.orderBy("_p")) - F.col(f"_{v}")).alias(f"_{v}") for v in values])  # a row a range
    own = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({v: F.sum(v).over(own) for v in values}).join(F.broadcast(before), "_p")
    return rows.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_p", "_i", *[f"_{v}" for v in values])


def adjacent(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """df with pos, prev and next: the column's values in the rows before and after in a total order, null at the ends. Neighbours are
    sought inside ranges; what a range's first and last rows miss comes from the ends of the ranges beside it, a row a range."""
    rows = _placed(ordered(df, order))
    inside, across = Window.partitionBy("_p").orderBy("_i"), Window.orderBy("_p")
    ends = rows.groupBy("_p").agg(F.min_by(column, "_i").alias("_first"), F.max_by(column, "_i").alias("_last"), F.count("*").alias("_n"))
    ends = ends.select("_p", "_n", F.lag("_last").over(across).alias("_left"), F.lead("_first").over(across).alias("_right"))
    rows = rows.withColumn("prev", F.lag(column).over(inside)).withColumn("next", F.lead(column).over(inside)).join(F.broadcast(ends), "_p")
    prev, nxt = F.when(F.col("_i") == 0, F.col("_left")).otherwise(F.col("prev")), F.when(F.col("_i") == F.col("_n") - 1, F.col("_right")).otherwise(F.col("next"))
    return rows.withColumn("prev", prev).withColumn("next", nxt).drop("_p", "_i", "_n", "_left", "_right")


def seek(keys: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """(target, found): the smallest key >= target, null if there is none; a row for each distinct target. Both are ordered together by
    range; each target takes the nearest key after it in its range, or else the first key of a later one: no pairs are made."""
    both = keys.select(F.col(key).alias("x"), F.lit(1).alias("is_key")).distinct().unionByName(targets.select(F.col(target).alias("x"), F.lit(0).alias("is_key")).distinct())
    rows = ordered(both, [F.col("x"), F.col("is_key")])
    own = F.when(F.col("is_key") == 1, F.col("x"))
    # backwards, so that the frame only grows
    near = rows.withColumn("near", F.last(own, ignorenulls=True).over(Window.partitionBy("_p").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = rows.groupBy("_p").agg(F.min(own).alias("_first"))
    later = firsts.select("_p", F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))  # a row a range
    # an equal key stands before its target when read backwards
    return near.where("is_key = 0").join(F.broadcast(later), "_p").select(F.col("x").alias("target"), F.coalesce("near", "_later").alias("found"))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """(k, prev_k, next_k) of the distinct keys, in key order."""
    rows = adjacent(df.select(F.col(key).alias("k")).distinct(), [F.col("k")], "k")
    return rows.select("k", F.col("prev").alias("prev_k"), F.col("next").alias("next_k"))
