"""Sorted runs: how operations are cut into files and blocks, and the statistics that prune them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LEVEL_BYTES, LEVEL_GROWTH
from .reads import positions, running_sums


def file_stats(log: DataFrame, file: Column) -> DataFrame:
    """(file_number, num_entries, smallest, largest, max_sequence): one aggregate."""
    return log.groupBy(file.cast("long").alias("file_number")).agg(F.count("*").alias("num_entries"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.max("seq").alias("max_sequence"))


def by_ops(size: int) -> Column:
    return F.floor((F.col("seq") - 1) / size)


def entry_bytes() -> Column:
    """Bytes of key, value and the eight-byte trailer of sequence and type."""
    return (F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 8).cast("long")


def running(log: DataFrame, order: list[Column]) -> DataFrame:
    """bytes of each entry, and sofar: running bytes in a total order, own entry included."""
    return running_sums(log.withColumn("bytes", entry_bytes()).withColumn("sofar", F.col("bytes")), order, ["sofar"])


def cut(log: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Numbers of files or blocks of about `size` bytes, by running sum."""
    return running(log, order).withColumn("part", F.floor((F.col("sofar") - 1) / size).cast("long"))


def _ends(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(id, begun, over) for intervals (id, low, high): files that begin at high or before, and files that end before low. Ends of all
    are brought into one order and counted as it goes by; no interval meets another."""
    end = lambda df, x, kind, a, b, i: df.select(F.col(x).alias("x"), F.lit(kind).alias("kind"), F.lit(a).alias("begun"), F.lit(b).alias("over"), i.alias("id"))
    none = F.lit(None).cast(asked.schema["id"].dataType)
    # of equal ends: a file's start, then a high, then a low, then a file's end
    rows = end(files, "smallest", 0, 1, 0, none).unionByName(end(asked, "high", 1, 0, 0, F.col("id"))).unionByName(end(asked, "low", 2, 0, 0, F.col("id"))).unionByName(end(files, "largest", 3, 0, 1, none))
    rows = running_sums(rows, [F.col("x"), F.col("kind")], ["begun", "over"]).where(F.col("kind").isin(1, 2))
    return rows.groupBy("id").agg(F.max(F.when(F.col("kind") == 1, F.col("begun"))).alias("begun"), F.max(F.when(F.col("kind") == 2, F.col("over"))).alias("over"))


def meets(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(id, meets): how many files' key ranges [smallest, largest] meet each interval [low, high]; ids are distinct."""
    return _ends(asked, files).select("id", (F.col("begun") - F.col("over")).cast("long").alias("meets"))


def overlaps(files: DataFrame) -> DataFrame:
    """(a_file, b_file), a < b, of files whose key ranges meet. In the order of their starts, a file meets just those after it that begin by
    its end: their places are listed and joined by equality, so nothing is made but the pairs themselves."""
    placed = positions(files.select("file_number", "smallest", "largest"), [F.col("smallest"), F.col("file_number")])
    begun = _ends(files.select(F.col("file_number").alias("id"), F.col("smallest").alias("low"), F.col("largest").alias("high")), files).select(F.col("id").alias("file_number"), "begun")
    after = placed.join(begun, "file_number").where("begun > pos").select(F.col("file_number").alias("a"), F.explode(F.sequence(F.col("pos") + 1, "begun")).alias("pos"))
    pairs = after.join(placed.select("pos", F.col("file_number").alias("b")), "pos")
    return pairs.select(F.least("a", "b").alias("a_file"), F.greatest("a", "b").alias("b_file"))


def prune(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(user_key, candidate_files): how many files may hold each distinct key."""
    return meets(keys.select(F.col("user_key").alias("id"), F.col("user_key").alias("low"), F.col("user_key").alias("high")).distinct(), files).select(F.col("id").alias("user_key"), F.col("meets").alias("candidate_files"))


def scores(files: DataFrame, levels: int) -> DataFrame:
    """(level, score): files / 4 on level 0, bytes over the level's limit below; levels without files score 0."""
    spark = files.sparkSession
    sums = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))
    limit = F.lit(float(LEVEL_BYTES)) * F.pow(F.lit(float(LEVEL_GROWTH)), F.greatest(F.col("level") - 1, F.lit(0)))
    every = spark.range(levels).select(F.col("id").cast("int").alias("level"))
    score = F.when(F.col("level") == 0, F.coalesce("n", F.lit(0)) / F.lit(4.0)).otherwise(F.coalesce("bytes", F.lit(0)) / limit)
    return every.join(sums, "level", "left").select("level", score.cast("double").alias("score"))


def pick_level(scored: DataFrame, levels: int) -> DataFrame:
    """The level of the largest score of at least 1, the lowest of equals, never the last."""
    return scored.where((F.col("score") >= 1) & (F.col("level") < levels - 1)).orderBy(F.desc("score"), "level").limit(1).select("level")


def pick_inputs(files: DataFrame, level: int) -> DataFrame:
    """(which, level, number): the level's oldest file (all that overlap it on level 0) and the next level's files that overlap those."""
    own = files.where(F.col("level") == level)
    seed = own.orderBy("number").limit(1)
    hit = lambda x, y: ~((F.col(f"{x}.largest") < F.col(f"{y}.smallest")) | (F.col(f"{y}.largest") < F.col(f"{x}.smallest")))
    chosen = own.alias("f").join(F.broadcast(seed.alias("s")), hit("f", "s"), "left_semi") if level == 0 else seed
    span = chosen.agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
    below = files.where(F.col("level") == level + 1).alias("f").join(F.broadcast(span.alias("s")), hit("f", "s"), "left_semi")
    return chosen.select(F.lit("input").alias("which"), "level", "number").unionByName(below.select(F.lit("next").alias("which"), "level", "number"))


def trivial_moves(files: DataFrame, level: int) -> DataFrame:
    """(number, old_level, new_level) of the level's files that nothing on the next level overlaps: metadata moves, no data does."""
    own = files.where(F.col("level") == level).select(F.col("number").alias("id"), F.col("smallest").alias("low"), F.col("largest").alias("high"))
    free = meets(own, files.where(F.col("level") == level + 1)).where("meets = 0")
    return free.select(F.col("id").alias("number"), F.lit(level).alias("old_level"), F.lit(level + 1).alias("new_level"))


def replay_edits(edits: DataFrame) -> DataFrame:
    """(level, number, edit_id) of live files: the last word on each file is an add. Within one edit, deletes come first."""
    last = edits.groupBy("level", "number").agg(F.max_by(F.struct("edit_id", "is_add"), F.struct("edit_id", "is_add")).alias("e"))
    return last.where("e.is_add = 1").select("level", "number", "e.edit_id")
