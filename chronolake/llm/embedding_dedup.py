"""Near-duplicate embeddings by lattice hashing: projections decoded to E8 points in several tables, neighbours probed, cosines verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, group_edges, ordered_groups, releasing, written
from .lattice import cells

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Pairs whose first meeting is looked up at once.
_PAIRS = 100_000


@dataclass(frozen=True)
class Tables:
    """tables x blocks random projections to eight dimensions; a cell is the tuple of its blocks' E8 points.

    width is the lattice's scale. With three blocks at 1/4, two vectors of 64 dimensions at cosine 0.95 meet in a table of one home and
    three probes about one time in four, so that sixteen tables miss about one pair in a hundred at that cosine and next to none above
    0.97, and one random pair in a hundred thousand meets. Eight tables of two blocks find as many from fewer keys, but there eight random
    pairs in ten thousand meet, which large inputs cannot compare.
    """

    tables: int = 16
    blocks: int = 3
    width: float = 0.25
    seed: int = 7

    @classmethod
    def suited(cls, rows: int) -> "Tables":
        """Tables for so many distinct vectors: the same for any number, so that a pair's link never depends on what other rows there are."""
        return cls()

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Hashed cells (n, tables, 1 + blocks) of unit rows: the home cell, then for each block the cell with that block's next point."""
        n, d = x.shape
        rng = np.random.default_rng(self.seed)
        out = np.empty((n, self.tables, 1 + self.blocks), np.uint64)
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                own, near = [], []
                for b in range(self.blocks):
                    at = x @ (rng.normal(size=(d, 8)) / (8 * self.width)) + rng.uniform(0, 2, 8)
                    h = ((cells(at, 1).astype(np.uint64) * _MIX).sum(2) * _MIX[b]) ^ np.uint64(b)
                    h = (h ^ (h >> np.uint64(29))) * _MIX[b + 1]
                    own.append(h[:, 0])
                    near.append(h[:, 1])
                home = sum(own, np.full(n, t + 1, np.uint64) * _MIX[7])
                out[:, t, 0] = home
                for b in range(self.blocks):
                    out[:, t, 1 + b] = home - own[b] + near[b]
        return out.astype(np.int64)


def usable(vector: str | Column) -> Column:
    """Not null, empty, zero, nor holding null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.concatenate(vectors.to_numpy()).astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(1, keepdims=True)  # tiny and huge components square safely
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: Groups up to so many rows are compared together, pair by pair; larger ones each by matrix products.
_SMALL = 48


class _Cells:
    """Links found among rows (of one length of vectors) that share a cell: sums of partners' weights, and a forest of the links."""

    def __init__(self, part: pd.DataFrame, edges: list[tuple[int, int]], tables: Tables, cosine: float):
        self.ids, self.weight, self.base, self.side, self.table = (part[c].to_numpy() for c in ("rep", "n", "base", "side", "t"))
        self.split = part["i"].to_numpy() != part["j"].to_numpy()
        self.x, self.edges, self.tables, self.cosine = _unit(part["v"]), edges, tables, cosine
        self.links, self.label = np.zeros(len(part), np.int64), np.arange(len(part))
        self.keys, self.row = np.empty((0, tables.tables, 1 + tables.blocks), np.int64), np.full(len(part), -1)

    def signatures(self, rows: np.ndarray) -> np.ndarray:
        """The cells of rows, hashed once for rows that link with any."""
        new = np.unique(rows[self.row[rows] < 0])
        if len(new):
            self.row[new] = len(self.keys) + np.arange(len(new))
            self.keys = np.concatenate([self.keys, self.tables.keys(self.x[new])])
        return self.keys[self.row[rows]]

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs meet here first: by table, at home, by the smaller id's probe, by the larger's. Each link counts only there."""
        swap = self.ids[a] > self.ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ka, kb = self.signatures(a), self.signatures(b)
        met = np.stack([ka[:, :, 0] == kb[:, :, 0], (ka[:, :, 1:] == kb[:, :, :1]).any(2), (kb[:, :, 1:] == ka[:, :, :1]).any(2)], axis=2)
        now = np.where(self.base[a] & self.base[b], 0, np.where(self.base[b], 1, 2))
        return met.reshape(len(a), -1).argmax(1) == self.table[a] * 3 + now

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of a group at the cosine, some at a time."""
        start, end = (np.zeros(len(self.ids), np.int64) for _ in range(2))
        for lo, hi in self.edges:
            if hi - lo <= _SMALL:
                start[lo:hi], end[lo:hi] = lo, hi
        for away in range(1, min(_SMALL, int((end - start).max(initial=0)))):
            a = np.flatnonzero(np.arange(len(end)) + away < end)
            for lo in range(0, len(a), _PAIRS):
                yield self.near(a[lo : lo + _PAIRS], a[lo : lo + _PAIRS] + away)
        for lo, hi in self.edges:
            if hi - lo > _SMALL:
                step = max(1, 2_000_000 // (hi - lo))
                for at in range(lo, hi, step):
                    a, b = np.nonzero(self.x[at : min(at + step, hi)] @ self.x[lo:hi].T >= self.cosine - 1e-9)
                    a, b = a + at, b + lo
                    a, b = a[a < b], b[a < b]
                    for k in range(0, len(a), _PAIRS):
                        yield self.near(a[k : k + _PAIRS], b[k : k + _PAIRS])

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of two chunks of a hot cell, pairs across; one of a pair at home; at the cosine, by one formula whatever the group's size."""
        fine = (self.base[a] | self.base[b]) & (self.ids[a] != self.ids[b]) & (~self.split[a] | (self.side[a] != self.side[b]))
        a, b = a[fine], b[fine]
        fine = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.cosine
        return a[fine], b[fine]

    def run(self) -> pd.DataFrame:
        for a, b in self.pairs():
            if len(a):
                mine = self.first_meeting(a, b)
                self.join(a, b)
                a, b = a[mine], b[mine]
                np.add.at(self.links, a, self.weight[b])
                np.add.at(self.links, b, self.weight[a])
        touched = (self.links > 0) | (self.label != np.arange(len(self.ids)))
        return pd.DataFrame({"id": self.ids[touched], "links": self.links[touched], "root": self.ids[self.label[touched]]})

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            if (la == lb).all():
                return
            low = np.minimum(la, lb)
            np.minimum.at(self.label, la, low)
            np.minimum.at(self.label, lb, low)
            self.label = self.label[self.label]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, tables: Tables | None = None, chunk: int = 512) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors; other columns are dropped.

    Equal vectors are one class first, so copies cost nothing more than their count. Each class goes to its home cell and to probed
    neighbouring cells of each table (the same tables whatever the input's size), as a key alone; vectors are fetched by those that share
    a cell, and home rows are compared with all rows of it in double precision. A pair is counted where it meets first, so counts are exact for all pairs that meet. A cell of more than `chunk` rows is
    dealt in chunks, and pairs of chunks meet in separate tasks: no group is held by one task, and no pair leaves its task, only counts
    and a spanning forest do. Recall is that of the tables (see Tables); a link is never below the cosine.

    Unusable vectors (see usable) and rows with a null key link with nothing: n_links 0, the key itself as component, kept. Vectors of
    different lengths never link. Rows that repeat a key are each a vector.
    """
    tables = tables or Tables()
    rows = vectors.select(F.col(key).alias("id"), F.when(usable(vector) & F.col(key).isNotNull(), F.col(vector)).alias("v"))
    good = rows.where("v IS NOT NULL")
    classes = written(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["v"].map(len)):
                k = tables.keys(_unit(part["v"])) + d
                n, t, c = k.shape
                yield pd.DataFrame({"cell": k.reshape(-1), "t": np.tile(np.repeat(np.arange(t, dtype=np.int16), c), n), "base": np.tile(np.arange(c) == 0, n * t), "rep": np.repeat(part["rep"].to_numpy(), t * c)})

    copies = written(classes.select("rep", "v").mapInPandas(spread, "cell long, t short, base boolean, rep long"))
    sizes = written(copies.groupBy("cell").agg(F.count("*").alias("m"), F.max("base").alias("any")).where("m > 1 AND any").select("cell", F.ceil(F.col("m") / chunk).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = copies.join(sizes, "cell").withColumn("ij", F.explode(others)).select("cell", "t", F.col("ij")["i"].alias("i"), F.col("ij")["j"].alias("j"), (own == F.col("ij")["j"]).cast("short").alias("side"), "base", "rep")
    dealt = dealt.join(classes.select("rep", "n", "v"), "rep")
    dealt = dealt.repartition(F.col("cell"), F.col("i"), F.col("j")).sortWithinPartitions("cell", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = ["cell", "i", "j"]
        for frame in ordered_groups(batches, by):
            for _, part in frame.groupby(frame["v"].map(len), sort=False):
                yield _Cells(part, group_edges(part, by), tables, cosine).run()

    found = written(dealt.mapInPandas(releasing(compare), "id long, links long, root long"))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    tops = components(found.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    reps = classes.join(links, "rep", "left").join(tops.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(reps, "v", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, (SELECT min(r.y) FROM r WHERE r.x = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(r.y) FROM r WHERE r.x = e.vec_id) AS kept FROM embeddings e
"""
