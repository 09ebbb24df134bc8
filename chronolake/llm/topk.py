"""Exact top-k by no-random-access aggregation: sorted lists are read in step, score bounds kept, and reading stops when no outsider can qualify."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .embedding_dedup import usable

#: Shares of the lists after which bounds are looked at, besides at the end.
LOOKS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)


class Lists:
    """One sorted list of (candidate, component) per dimension over a block of candidates. A query reads each list from its best end: the
    high one where its own component is positive, the low one where it is negative."""

    def __init__(self, x: np.ndarray):
        self.n, self.d = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.value, self.order = np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T), np.ascontiguousarray(order.T)

    def top(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """(query, ids, scores, depth) of each query's k best, ties to the smaller id; own: the query's id, which never counts; depth: the
        share of the lists read when no candidate outside the k best and their ties could qualify any more.

        All lists are read in step, and what was read since the last look is added to its candidates' partial scores, for all queries at
        once: candidates are never looked up. A component not yet read is worth between the list's last and the one read last, which
        bounds every score from both sides. Candidates whose upper bound is below the k-th best lower one are out; lists are read on, for
        those that remain for some query only, until their scores are whole.
        """
        # all sums are of integers: single precision is exact while none can pass 2^24
        kind = np.float32 if np.abs(self.value).max() * np.abs(queries).max() * self.d < 2**24 else np.float64
        values, queries = self.value.astype(kind), queries.astype(kind)
        weights = np.concatenate([np.maximum(queries, 0).T, np.minimum(queries, 0).T])  # of what is read from the high ends, from the low ends
        active, out = np.arange(len(queries)), own[None, :] == ids[:, None]  # (candidates, queries): those that are out
        score, unread = np.zeros((self.n, len(queries)), kind), np.ones((self.n, 2 * self.d), kind)
        depths, alive, read, lists = np.ones(len(queries)), np.arange(self.n), 0, np.arange(self.d)[:, None]
        for depth in sorted({max(1, int(self.n * s)) for s in LOOKS} | {self.n}):
            new = np.zeros((self.n, 2 * self.d), kind)
            for end, part in enumerate((slice(self.n - depth, self.n - read), slice(read, depth))):
                at = self.order[:, part], lists + end * self.d
                new[at], unread[at] = values[:, part], 0
            score[alive] += new[alive] @ weights
            read = depth
            if depth < self.n:
                last, now = np.concatenate([values[:, 0], values[:, -1]]), np.concatenate([values[:, self.n - depth], values[:, depth - 1]])
                lower, upper = (score + unread @ (weights * v[:, None]) for v in (last, now))
            else:
                lower = upper = score
            lower = np.where(out, -np.inf, lower)
            kth = np.partition(lower, max(0, self.n - k), axis=0)[max(0, self.n - k)]
            out |= upper < kth
            can = ~out
            many = can.sum(0)
            # no outsider is left when as many remain as there are places, or only ties
            settled = (many <= k) | (np.where(can, lower, np.inf).min(0) == np.where(can, upper, -np.inf).max(0))
            depths[active] = np.where(settled, np.minimum(depths[active], depth / self.n), depths[active])
            whole = np.array([depth == self.n or bool(m <= 8 * k and (lower[c, i] == upper[c, i]).all()) for i, (m, c) in enumerate(zip(many, can.T, strict=True))])
            for i in np.flatnonzero(whole):
                some = np.flatnonzero(can[:, i])
                best = np.lexsort((ids[some], -lower[some, i]))[:k]  # where both bounds agree, they are the score, read to its end or not
                yield int(active[i]), ids[some][best], lower[some[best], i], float(depths[active[i]])
            if whole.all():
                return
            if whole.any():
                active, out, score, weights = active[~whole], out[:, ~whole], score[:, ~whole].copy(), weights[:, ~whole].copy()
            alive = np.flatnonzero(~out.all(1))


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, candidates: int = 8192, queries: int = 512) -> DataFrame:
    """(query_id, rank, key, score, depth): each query's k candidates of highest integer inner product over floor(scale * component);
    depth: the largest share of a block's lists that was read before no outsider could qualify for its k best.

    Every block of queries meets every block of candidates in a task of its own (a stated query set against all rows); each gives k rows
    a query at most, and those are merged. Blocks are dealt by a hash of the key and their sizes do not grow with the table. Ties go to
    the smaller key. A query's own key never counts; unusable vectors and null keys take no part, zero vectors do; vectors of another
    length than a query's are not its candidates. Fewer than k candidates: all of them.
    """
    zero = F.forall(vector, lambda x: x == 0) & (F.size(vector) > 0)
    rows = vectors.where((usable(vector) | zero) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("v"))
    asked = rows.where(is_query(F.col("id")))
    total, some = rows.agg(F.count("*"), F.count(F.when(is_query(F.col("id")), 1))).first()
    many, few = max(1, -(-total // candidates)), max(1, -(-some // queries))

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(names[0]), "id"), F.lit(own)).cast("int")
        return df.select(block.alias(names[0]), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]), F.size("v").alias("d"), F.col("id").alias("id"), F.col("v").alias("v"))  # attributes of its own on either side

    left = dealt(asked, few, many, ("q", "c")).groupBy("q", "c", "d")
    right = dealt(rows, many, few, ("c", "q")).groupBy("q", "c", "d")

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            ids, own = there["id"].to_numpy(), asked["id"].to_numpy()
            lists = Lists(np.array(there["v"].tolist(), np.float64))
            for q, best, score, depth in lists.top(np.array(asked["v"].tolist(), np.float64), own, ids, k):
                out.append(pd.DataFrame({"query_id": own[q], "id": best, "score": score.astype(np.int64), "depth": depth}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64").assign(depth=0.0)

    found = left.cogroup(right).applyInPandas(run, "query_id long, id long, score long, depth double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score", F.max("depth").over(Window.partitionBy("query_id")).alias("depth"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0).drop("depth")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
