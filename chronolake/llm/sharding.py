"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.reads import positions
from .common import written

#: Draws of a key before it must have settled. A key makes about ln(shards) jumps; a hundred more than that is out of reach.
_JUMPS = 128


def jump(key: Column, shards: int) -> Column:
    """struct(shard, next): the key's shard among `shards`, and the first shard count at which it would leave, less one.

    From bucket b the key leaps to floor((b + 1) / r), r a uniform draw in (0, 1] from (key, b); the last bucket below `shards` is its
    shard. The leaps do not depend on `shards`: with n + 1 shards the key sits in n if a leap lands there, else where it was. So one
    pass gives both answers. The draw is a digest of key and bucket, since 64-bit multiplication that wraps is an error in ANSI mode.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    state = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def leap(s: Column, _: Column) -> Column:
        # 52 bits of a digest of key and bucket; concat_ws leaves a null key out
        digits = F.conv(F.substring(F.md5(F.concat_ws(":", key, s["j"].cast("string")).cast("binary")), 1, 13), 16, 10)
        draw = (digits.cast("long") + F.lit(1)).cast("double") / F.lit(float(2**52))
        far = F.floor(F.least((s["j"] + F.lit(1)).cast("double") / draw, F.lit(float(2**52)))).cast("long")
        return F.when(s["j"] >= F.lit(shards), s).otherwise(F.struct(s["j"].alias("b"), F.greatest(far, s["j"] + F.lit(1)).alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, _JUMPS))), state, leap)


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of df; other columns are dropped.

    The shard depends on the key (as text) and `shards` alone; a null key is a key of its own, and rows of one key share a shard. size:
    UTF-8 bytes plus 1, null or empty text 1. slot numbers each shard's rows from 0 without gaps, by key (nulls first), size, checksum:
    the same whatever files or partitions rows come in; rows that are alike in all of these take theirs in any order.

    Texts are read once. Narrow rows are brought into one order by range, a place each added, so that not even a key that repeats sits in
    one task; what is joined to them is a row for each range and one for each shard. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), jump(F.col(key).cast("string"), shards).alias("_j"), F.monotonically_increasing_id().alias("_at"))
    # written, so that all passes below see the same rows even if an executor is lost between them
    narrow = written(narrow.select(key, "size", "text_crc32", F.col("_j")["b"].cast("int").alias("shard"), F.when(F.col("_j")["j"] == shards, shards).otherwise(F.col("_j")["b"]).cast("int").alias("grown_shard"), "_at"))
    placed = positions(narrow, [F.col("shard"), F.col(key), F.col("size"), F.col("text_crc32"), F.col("_at")])
    starts = narrow.groupBy("shard").agg(F.count("*").alias("_n")).select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_start"))  # a row a shard
    return placed.join(F.broadcast(starts), "shard").select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("pos") - F.col("_start") - 1).cast("long").alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


ORACLE = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS crc_of),
c AS MATERIALIZED (SELECT doc_id, strlen(t) + 1 AS size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(t), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
     lambda r, x: xor(r >> 8, crc_of[(xor(r, x) & 255)::INT + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM d, b),
j AS (SELECT DISTINCT doc_id, 0::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL SELECT doc_id, j, greatest(CAST(floor(least((j + 1)::DOUBLE / ((CAST('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, j::VARCHAR)), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0), 4503599627370496.0)) AS BIGINT), j + 1) FROM j WHERE j < 8),
s AS (SELECT doc_id, b::INT AS shard, CASE WHEN j = 8 THEN 8 ELSE b END::INT AS grown_shard FROM j WHERE j >= 8)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM c JOIN s ON c.doc_id IS NOT DISTINCT FROM s.doc_id
"""
