"""Shared pieces: columns added by Python, stable hashes of ids, word splitting and components of a link graph."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import kept_only, written

__all__ = ["added", "bounded_sample", "components", "group_edges", "held_out", "kept_only", "ordered_groups", "releasing", "remainder", "stratified_sample", "words", "written"]


def remainder(key: str | Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % divisor


def held_out(key: str | Column, divisor: int) -> Column:
    """True for rows that no model may learn from; a null key is never held out."""
    return F.coalesce(remainder(key, divisor) == 0, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8, with A-Z lower-cased and nothing else changed: bytes know no other letters and blanks than ASCII's."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ordered_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by `by`, several to a frame; only the last group waits for the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and not (held[0][by].iloc[0] == batch[by].iloc[-1]).all():
            batch, held = pd.concat([*held, batch]), []
        if held:
            held.append(batch)
            continue
        last = (batch[by] == batch[by].iloc[-1]).all(axis=1).to_numpy()
        if not last.all():
            yield batch[~last]
        held = [batch[last]]
    if held:
        yield pd.concat(held)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker gives what it freed back to the system: workers are reused, and the allocator would keep the most they ever held."""
    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return wrapped


def added(docs: DataFrame, text: str, fields: list[T.StructField], scorer: Callable[[], Callable[[list[str | None]], list[list]]], drop_text: bool = False) -> DataFrame:
    """docs with fields computed from one text column, in one pass without a shuffle; scorer() makes, in each task, what gives a list for
    each field from a list of texts.

    All other columns pass as the Arrow arrays they are, so a key of 64 bits beside a null keeps all of them (pandas would make the
    column one of floats). Columns that have a field's name are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.drop(*[f.name for f in fields if f.name in docs.columns])
    kept = [c for c in docs.columns if not (drop_text and c == text)]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            new = score(batch.column(at[text]).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in kept], *[pa.array(x, k) for x, k in zip(new, kinds, strict=True)]], [*kept, *[f.name for f in fields]])

    return docs.mapInArrow(releasing(run), T.StructType([*[docs.schema[c] for c in kept], *fields]))


def group_edges(frame: pd.DataFrame, by: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the groups in a frame of ordered_groups."""
    new = (frame[by].to_numpy()[1:] != frame[by].to_numpy()[:-1]).any(axis=1)
    at = [0, *(np.flatnonzero(new) + 1).tolist(), len(frame)]
    return list(zip(at[:-1], at[1:], strict=True))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: str) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of the key: all rows if there are no more, else the fraction that fits.

    One count fixes the fraction, so no executor and no sort ever holds the whole table.
    """
    n = df.count()
    if n <= bound:
        return df
    share = int(bound / n * 2**30)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(2**30)) < share)


def stratified_sample(df: DataFrame, key: str, by: str, bound: int, seed: str) -> tuple[DataFrame, dict]:
    """About `bound` rows at most, chosen by a hash of the key, and the rows of each class `by` in df. Classes share the bound evenly; what
    small ones leave goes to the others, so no class is lost among larger ones. One count for each class reaches the driver."""
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
    left, share = bound, {}
    for i, (c, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        quota = left / (len(sizes) - i)
        share[c] = min(1.0, quota / n)
        left -= min(n, quota)
    if all(x == 1.0 for x in share.values()):
        return df, sizes
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(2**30))
    least = F.lit(0)
    for c, x in share.items():
        least = F.when(F.col(by).eqNullSafe(F.lit(c)), int(x * 2**30)).otherwise(least)
    return df.where(draw < least), sizes


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node that links reach.

    Each round takes the smallest label next to a node, then follows labels once (pointer jumping), so a chain of length n takes about
    log n rounds. Labels are written to the shared folder each round; the driver sees one count per round. Rows with a null end are
    ignored; repeated edges and a == b do no harm. Raises if `rounds` do not suffice.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        # the ends' labels learn of each other too, so whole trees hook together
        hooks = near.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.least("la", "lb").alias("to")), F.struct(F.col("b").alias("node"), F.least("la", "lb").alias("to")),
            F.struct(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("to")))).alias("h")).select("h.*").groupBy("node").agg(F.min("to").alias("to"))
        hooked = labels.join(hooks, "node", "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label"), F.col("to").isNotNull().alias("moved"))
        hooked = written(hooked)
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(hooked.join(roots, "label", "left").select("node", F.coalesce("up", "label").alias("label"), (F.col("moved") | F.coalesce(F.col("up") != F.col("label"), F.lit(False))).alias("moved")))
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
