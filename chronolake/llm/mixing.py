"""Mixing sources to target weights: a temperature found by bisection, weights realised as permuted blocks; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Halvings of the interval that one job decides: it evaluates all 2^8 - 1 midpoints that they can reach.
_HALVINGS = 8
#: Grain of the block permutations, and of the coarse bins in which their cumulative sizes are found.
_GRAIN, _BINS = 2**24, 1024
#: So that a small source, too, can be used in part.
LEAST_BLOCKS = 64


@dataclass(frozen=True)
class Target:
    """What the exponent must meet: an entropy of the weights in nats (least, capped by what sources allow) or a repetition limit."""

    entropy: float | None = None
    repetition: float | None = None


def token_count(text: Column) -> Column:
    """Words and one end; so no source weighs nothing."""
    return (F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)) + 1).cast("long")


def shares(sized: DataFrame) -> DataFrame:
    """(source, tokens): one row a source, null a source of its own; pre-aggregated before its only shuffle."""
    return sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def _moments(table: DataFrame, total: int, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """For each exponent a: sum of s^a, sum of s^a ln s, and largest s^(1 - a) over the sources; s is a source's share."""
    s = F.col("tokens") / F.lit(float(total))
    rows = table.select(s.alias("s"), F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    rows = rows.groupBy("a").agg(F.sum(F.pow("s", F.col("a"))).alias("z"), F.sum(F.pow("s", F.col("a")) * F.log("s")).alias("zl"), F.max(F.pow("s", 1 - F.col("a"))).alias("top"), F.min(F.pow("s", 1 - F.col("a"))).alias("low"))
    return {r["a"]: (r["z"], r["zl"], r["top"] / r["low"]) for r in rows.collect()}


def exponent(table: DataFrame, total: int, target: Target, rounds: int = 4) -> float:
    """The smallest exponent in [0, 1] that repeats no source over the limit, or the largest that keeps the entropy.

    Both measures are monotone in the exponent, which is bisected 8 x `rounds` times. Each round is one aggregation over the sources
    table, whatever its length, and brings 255 rows to the driver.
    """
    def meets(a: float, of: dict) -> bool:
        z, zl, spread = of[a]
        if target.repetition is not None:
            return spread <= target.repetition
        return math.log(z) - a * zl / z <= target.entropy

    low, high = 0.0, 1.0
    ends = _moments(table, total, [low])
    if meets(low, ends):
        return low
    for _ in range(rounds):
        n = 2**_HALVINGS
        at = [low + (high - low) * k / n for k in range(1, n)]
        of = _moments(table, total, at)
        below, above = 0, n  # the target is not met at below, and is at above
        for _ in range(_HALVINGS):
            middle = (below + above) // 2
            below, above = (below, middle) if meets(at[middle - 1], of) else (middle, above)
        low, high = low + (high - low) * below / n, low + (high - low) * above / n
    return high


def mix(docs: DataFrame, target: Target, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = 65_536, seed: int = 0) -> DataFrame:
    """All columns of docs, once for every time a document is used, with _tokens, _weight, _epoch and _order.

    Weights are the sources' token shares to an exponent, normalised. `budget` tokens are spent in all; without one, as many as let every
    source appear whole at least once, so that nothing is lost and the largest source appears once. A source's budget is spent in
    epochs: whole passes, then the blocks that come first in the epoch's own permutation until the budget is reached, the last block
    whole. Blocks hold about `block_tokens` tokens, less where a source would have under 64 of them, and are dealt by a hash of the key, so a hot source spreads over all tasks. Sorting by
    _order interleaves the sources in proportion. Sources, null among them, are compared null-safe; null or empty texts count one token;
    repeated rows are rows, and rows of one key share a block; an empty table gives no rows. Only per-source rows are joined to the
    documents: Spark broadcasts that table if it is small by its own threshold, else splits hot sources.
    """
    spent = ["_tokens", "_weight", "_epoch", "_order"]
    if clash := [c for c in docs.columns if c in spent]:
        docs = docs.drop(*clash)
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"))
    sized = written(sized)
    table = written(shares(sized))
    total = table.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return docs.limit(0).select("*", F.lit(0).cast("long").alias("_tokens"), F.lit(0.0).alias("_weight"), F.lit(0).alias("_epoch"), F.lit(0.0).alias("_order"))
    a = exponent(table, total, target)
    s = F.col("tokens") / F.lit(float(total))
    z, top = table.agg(F.sum(F.pow(s, F.lit(a))), F.max(F.pow(s, F.lit(1 - a)))).first()
    spend = float(budget) if budget is not None else total * z * top
    plan = table.select("source", F.col("tokens").alias("t"), (F.pow(s, F.lit(a)) / z).alias("w"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"))
    passes = F.col("w") * F.lit(spend) / F.col("t")
    whole = F.floor(passes + F.lit(1e-9))
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("part", F.greatest(F.lit(0.0), F.col("w") * F.lit(spend) - F.col("whole") * F.col("t")))

    def block(of: str | Column, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), of), blocks)

    def turn(epoch: str | Column, of: Column, which: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), epoch, of, which), F.lit(_GRAIN))

    same = F.col("source").eqNullSafe(F.col("p_source"))
    params = plan.withColumnRenamed("source", "p_source")
    # sizes of the blocks, in the order of the last epoch's permutation; cumulated in bins, so that no task holds a source's blocks
    sizes = sized.join(params, same).withColumn("block", block("key", F.col("blocks"))).groupBy("source", "block", "whole", "part").agg(F.sum("tokens").alias("n"))
    sizes = written(sizes.withColumn("turn", turn(F.col("whole"), F.col("source"), F.col("block"))).withColumn("bin", F.floor(F.col("turn") / (_GRAIN // _BINS))))
    bins = sizes.groupBy("source", "bin").agg(F.sum("n").alias("in_bin")).withColumn("before", F.expr("sum(in_bin) OVER (PARTITION BY source ORDER BY bin ROWS UNBOUNDED PRECEDING) - in_bin"))
    bins = bins.select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), "before")
    summed = sizes.withColumn("sofar", F.expr("sum(n) OVER (PARTITION BY source, bin ORDER BY turn, block ROWS UNBOUNDED PRECEDING) - n"))
    summed = summed.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    limit = summed.where(F.col("before") + F.col("sofar") < F.col("part") - 0.5).groupBy("source").agg(F.max("turn").alias("last"))
    params = written(params.join(limit.withColumnRenamed("source", "l_source"), F.col("p_source").eqNullSafe(F.col("l_source")), "left").select("p_source", "w", "blocks", "whole", F.coalesce("last", F.lit(-1)).alias("last"), passes.alias("passes")))

    # under names of our own, so that no column of docs meets one of the parameters'
    names = [f"_c{i}" for i in range(len(docs.columns))]
    out = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(key).alias("_key"), F.col(source).alias("_source"), token_count(F.col(text)).alias("_tokens"))
    out = out.join(params, F.col("_source").eqNullSafe(F.col("p_source"))).withColumn("_block", block("_key", F.col("blocks")))
    last = turn(F.col("whole"), F.col("_source"), F.col("_block")) <= F.col("last")
    times = F.col("whole") + last.cast("int")
    out = out.where(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    order = (F.col("_epoch") + turn(F.col("_epoch"), F.col("_source"), F.col("_block")) / F.lit(float(_GRAIN))) / F.greatest(F.col("passes"), F.lit(1e-12))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], "_tokens", F.col("w").alias("_weight"), "_epoch", order.alias("_order"))


#: No source is used more than this many times as often as the one used least.
REPETITION = 4.0


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs.select("doc_id", "text", "source"), Target(repetition=REPETITION))
    return mixed.select("doc_id", "source", F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_epoch").alias("epoch"), F.col("_order").alias("order_key"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated so that sources meet their weights, in the order that interleaves them; every row stays at least once, whatever
    is null in it; a null source is a source of its own; an empty table stays empty."""
    mixed = mix(docs, Target(repetition=REPETITION))
    return mixed.repartitionByRange("_order").sortWithinPartitions("_order").select(*docs.columns)
