"""N-gram Jaccard join: inverted lists of word shingles, searched for documents that occur often enough (T-occurrence, DivideSkip)."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, components, group_edges, kept_only, ordered_groups, releasing, words, written

REMEMBERED = 300_000
#: Shingles of an index that one task builds (two such chunks meet in a task). Components of more documents than PART are dealt finer, to
#: up to PARTS chunks, so that no task has most of the work.
CHUNK, PART, PARTS = 1_000_000, 500, 16
#: Documents up to which the list of those to look at closely is broadcast (8 bytes each); beyond it, Spark joins by shuffle or as it sees fit.
SENT = 400_000
#: The same for bare keys of documents that go.
SENT_KEYS = 1_000_000
#: Shingles whose lists are not brought together, at most (16 bytes each, broadcast), and classes among which they are sought.
FREQUENT, FREQUENT_SAMPLE = 10_000, 20_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


@dataclass(frozen=True)
class Rule:
    """Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct `width`-word shingles."""

    width: int = 3
    percent: int = 90

    def overlap(self, n):
        """Least intersection with any linked document, of a set of n."""
        return -(-self.percent * n // 100)

    def spare(self, n):
        """Shingles that a linked document may lack; at least one, so that prefixes are never empty."""
        return np.maximum(1, n - self.overlap(n))

    def prefix(self, n):
        """Shingles (first in the common order) of which linked documents share at least spare(min(n)): spare + spare, or all."""
        return np.minimum(n, 2 * self.spare(n))

    def shared(self, n):
        """Prefix shingles that any linked document shares at least: its size is percent / 100 of n at least."""
        return self.spare(self.overlap(n))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; each distinct word is hashed once while it is remembered."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = words(text)
        if not found:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        get, new = known.get, xxhash.xxh64_intdigest
        at = np.array([h if (h := get(w)) is not None else known.setdefault(w, new(w)) for w in found], np.uint64)
        n = max(1, len(at) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(self.width, len(at))):
            out = (out ^ at[i : i + n]) * _A
            out ^= out >> np.uint64(31)
        if len(at) < self.width:
            out ^= np.uint64(len(at))
        out *= _D
        out ^= out >> np.uint64(29)
        out = np.sort(out.view(np.int64))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Index:
    """Inverted lists over the shingle sets of some documents, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.docs = flat[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.tokens, self.starts = flat[new], np.append(new, len(flat))

    def search(self, query: np.ndarray, least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, overlaps) of the wanted documents (a mask) that share at least `least` shingles with the query.

        DivideSkip: of the query's lists, the longest are put aside, fewer than `least` of them; the short ones are merged by a heap, and
        only documents met often enough there are looked up in the long lists, by binary search, dropping out as soon as they cannot
        reach `least`. Every list is used, so overlaps are exact.
        """
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens))]
        at = at[np.isin(self.tokens[at], query, assume_unique=False)]
        none = np.zeros(0, np.int64)
        if len(at) < least:
            return none, none
        lengths = self.starts[at + 1] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        # how many long lists pay: more if they are long, as each costs a binary search for every survivor
        aside = min(least - 1, int(least / (0.05 * np.log2(max(2, lengths.max())) + 1)))
        short, long = at[order[: len(at) - aside]], at[order[len(at) - aside :]]
        lists = [self.docs[self.starts[t] : self.starts[t + 1]] for t in short]
        found, count = merged([x[wanted[x]].tolist() for x in lists], least - aside)
        for i, t in enumerate(long):
            if not len(found):
                return none, none
            own = self.docs[self.starts[t] : self.starts[t + 1]]
            p = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[p] == found)
            keep = count + (len(long) - i - 1) >= least
            if not keep.all():
                found, count = found[keep], count[keep]
        return found, count


def merged(lists: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that stand in at least `least` of some ascending lists, and in how many: a heap holds the lists' heads. Where too few heads
    agree, as many lists as cannot decide are taken from the heap together and leap to the next head."""
    heads = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    at, found, count = [0] * len(lists), [], []
    while len(heads) >= least:
        top, out = heads[0][0], []
        while heads and heads[0][0] == top:
            out.append(heapq.heappop(heads)[1])
        if len(out) >= least:
            found.append(top)
            count.append(len(out))
            goal = top + 1
        else:
            while len(out) < least - 1:
                out.append(heapq.heappop(heads)[1])
            goal = heads[0][0]
        for i in out:
            x = lists[i]
            n = bisect_left(x, goal, at[i])
            at[i] = n
            if n < len(x):
                heapq.heappush(heads, (x[n], i))
    return np.array(found, np.int64), np.array(count, np.int64)


def forest(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, rule: Rule, across: bool) -> list[tuple[int, int]]:
    """Links that join all of a group's documents that links join: a document already joined to the query is not looked up again.

    across: only links between the two sides are sought (either side's own links are another group's work).
    """
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    ids, sides, index = ids[by_size], sides[by_size], Index([sets[i] for i in by_size])
    tree, out = np.arange(len(ids)), []
    for q in range(len(ids)):
        n = int(index.sizes[q])
        # each pair from its smaller set, so from the set that stands first
        wanted = tree != tree[q]
        wanted[: q + 1] = False
        wanted[np.searchsorted(index.sizes, 100 * n // rule.percent, "right") :] = False
        if across:
            wanted &= sides != sides[q]
        if not wanted.any():
            continue
        found, both = index.search(sets[by_size[q]], rule.overlap(n), wanted)
        for f in found[100 * both >= rule.percent * (n + index.sizes[found] - both)].tolist():
            if tree[f] != tree[q]:
                tree[tree == tree[f]] = tree[q]
                out.append((int(ids[q]), int(ids[f])))
    return out


def text_hash(text: str | Column) -> Column:
    """Tells apart the texts of rows that share a key; null as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _sets(docs: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """(id, x, n, h, g, prefix) for every row: the text's hash, size and 128-bit digest of its set, and the set's prefix in hash order. No
    words: n is 0 and the prefix empty. Keys pass as they are, null or not."""
    names = ["id", "x", "n", "h", "g", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(rule.width)
        for batch in batches:
            rows = []
            for t in batch.column(2).to_pylist():
                s = shingle(t)
                d = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), s[: int(rule.prefix(len(s)))] if len(s) else s))
            n, h, g, p = zip(*rows, strict=True) if rows else ((), (), (), ())
            prefix = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]), pa.int32()), pa.array(np.concatenate(p) if p else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), prefix], names)

    return docs.select(F.col(key).cast("long").alias("id"), text_hash(text).alias("x"), F.col(text).alias("t")).mapInArrow(releasing(run), "id long, x long, n long, h long, g long, prefix array<long>")


def _spare(n: Column, rule: Rule) -> Column:
    return F.greatest(F.lit(1), n - F.ceil(F.lit(rule.percent) * n / 100).cast("long")).cast("long")


def candidates(classes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): edges whose components hold every linked pair of classes (rep, n, prefix).

    Linked sets share at least shared(n) shingles of their prefixes. So in each prefix the shared(n) - 1 most frequent shingles may be
    left out: the rarest shared one stays on both sides, order being (documents that have it in their prefix, hash), which is counted
    over all documents. A document whose prefix is its own alone is out at once; a passage that many share connects only documents
    that consist of it for the most part. Each list gives a star, never its pairs.
    """
    frequent = _frequent(classes)
    few = F.broadcast(frequent)
    lists = classes.select("rep", F.explode("prefix").alias("token"))
    rare = lists.join(few.select("token"), "token", "left_anti")
    # counted in part before the shuffle; the many shingles of one document only end here
    counts = rare.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = lists.join(few, "token").where("df > 1").unionByName(rare.join(counts, "token")).join(classes.select("rep", "n"), "rep")
    lists = lists.withColumn("m", F.expr("count(*) OVER (PARTITION BY rep)")).withColumn("least", _spare(F.ceil(F.lit(rule.percent) * F.col("n") / 100).cast("long"), rule))
    lists = lists.where("m >= least").withColumn("r", F.expr("row_number() OVER (PARTITION BY rep ORDER BY df, token)")).where("r <= m - least + 1")
    stars = written(lists.select("rep", "token"))
    hubs = stars.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    few = F.broadcast(frequent.select("token"))
    wide = stars.join(F.broadcast(hubs.join(few, "token", "left_semi")), "token")
    narrow = stars.join(few, "token", "left_anti").join(hubs, "token")
    return wide.unionByName(narrow).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def _frequent(classes: DataFrame) -> DataFrame:
    """(token, df): prefix shingles that a sample shows in one class of 500 or more, FREQUENT at most, counted over all classes.

    Their rows stay where they are and meet this table by broadcast, so no task holds such a list; one that the sample misses costs time,
    nothing else, as both ways give the same rows.
    """
    some = bounded_sample(classes, "rep", FREQUENT_SAMPLE, "frequent")
    least = max(4, some.count() // 500)
    seen = some.select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    seen = written(seen.orderBy(F.desc("count"), "token").limit(FREQUENT).select("token"))
    return written(classes.select(F.explode("prefix").alias("token")).join(F.broadcast(seen), "token").groupBy("token").agg(F.count("*").alias("df")))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule(), chunk: int = CHUNK) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs; component_id is the smallest key that links reach.

    1. Whole texts become sets; equal sets are one class, so copies cost one row each. 2. Rare prefix shingles give components of
    candidates (see candidates). 3. Candidates' texts are read again, and each component is searched by T-occurrence in one task; a
    component of more than `chunk` shingles is dealt by size bands, only neighbours of which can link, and those by hash into chunks
    that meet in pairs, so no task holds a group of any size. Every link between different sets is found or joins what is joined
    already; nothing is capped or estimated, but that shingles are compared by 64-bit hashes.

    Texts without words (null, empty, blank) have n_shingles 0 and link with nothing; a null key links with nothing and its
    component is null; rows that repeat a key are each a document, with its own text. An empty table gives no rows. Other columns are
    dropped.
    """
    found = _joined(docs, key, text, rule, chunk)
    return found.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.col("top")["id"].alias("component_id"))


def _joined(docs: DataFrame, key: str, text: str, rule: Rule, chunk: int = CHUNK) -> DataFrame:
    """(id, x, n, top) for every row of docs; top: smallest (id, x) that links reach, null for a null id."""
    sets = written(_sets(docs, key, text, rule))
    some = sets.where("n > 0 AND id IS NOT NULL")
    classes = written(some.groupBy("n", "h", "g").agg(F.min(F.struct("id", "x")).alias("first"), F.first("prefix").alias("prefix")).withColumn("rep", F.monotonically_increasing_id()))
    spark = docs.sparkSession
    groups = kept_only(spark, lambda: components(candidates(classes, rule)).select(F.col("node").alias("rep"), F.col("component").alias("c")).join(classes.select("rep", "n", "first"), "rep"))
    found = written(_links(docs, groups, key, text, rule, chunk))
    tops = kept_only(spark, lambda: components(found)).withColumnRenamed("node", "rep").join(classes.select("rep", "first"), "rep")
    least = tops.groupBy("component").agg(F.min("first").alias("top"))
    tops = tops.join(least, "component").select("rep", "top")
    classes = classes.select("n", "h", "g", "rep", "first").join(tops, "rep", "left").select("n", "h", "g", F.coalesce("top", "first").alias("top"))
    out = sets.select("id", "x", "n", "h", "g").join(classes, ["n", "h", "g"], "left")
    return out.select("id", "x", "n", F.when(F.col("id").isNotNull(), F.coalesce("top", F.struct("id", "x"))).alias("top"))


def _links(docs: DataFrame, groups: DataFrame, key: str, text: str, rule: Rule, chunk: int) -> DataFrame:
    """(a, b): verified links that join all linked candidates."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / rule.percent)) + F.lit(1e-9)).cast("int")
    # written, so that Spark knows how few they are and need not deal the rows of a large component to one task
    large = written(groups.groupBy("c").agg(F.sum("n").alias("all")).where(F.col("all") > chunk).select("c", F.lit(True).alias("large")))
    of = groups.join(large, "c", "left").withColumn("windows", F.when(F.col("large"), F.array(band - 1, band)).otherwise(F.array(F.lit(-2))))
    of = of.withColumn("w", F.explode("windows")).select("rep", "n", "c", "w", "first")
    dealt_to = F.greatest(F.ceil(F.sum("n") / chunk), F.least(F.ceil(F.count("*") / PART), F.lit(PARTS))).cast("int")
    parts = written(of.groupBy("c", "w").agg(dealt_to.alias("chunks"), F.count("*").alias("k")).where("k > 1").drop("k"))
    of = of.join(parts, ["c", "w"]).groupBy("rep", "first").agg(F.collect_list(F.struct("c", "w", "chunks")).alias("at"))  # two windows at most
    of = written(of.select("rep", F.col("first")["id"].alias("id"), F.col("first")["x"].alias("x"), "at"))
    near = F.broadcast(of) if of.count() <= SENT else of
    texts = docs.select(F.col(key).cast("long").alias("id"), text_hash(text).alias("x"), F.col(text).alias("t")).join(near, ["id", "x"]).dropDuplicates(["rep"])
    own = F.pmod(F.xxhash64("rep"), F.col("p")["chunks"]).cast("int")
    dealt = texts.withColumn("p", F.explode("at")).withColumn("own", own)
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("p")["chunks"] - 1)))
    dealt = dealt.select(F.col("p")["c"].alias("c"), F.col("p")["w"].alias("w"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side"), "rep", "t")
    by = ["c", "w", "i", "j"]
    dealt = dealt.repartition(*[F.col(x) for x in by]).sortWithinPartitions(*by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(rule.width)
        for frame in ordered_groups(batches, by):
            ids, side, i, j, body = frame["rep"].to_numpy(), frame["side"].to_numpy(), frame["i"].to_numpy(), frame["j"].to_numpy(), frame["t"].tolist()
            edges = [e for lo, hi in group_edges(frame, by) if hi - lo > 1 for e in forest(ids[lo:hi], [shingle(t) for t in body[lo:hi]], side[lo:hi], rule, i[lo] != j[lo])]
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    return dealt.mapInPandas(releasing(run), "a long, b long")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: What the pipeline takes for near-duplicates: five words, 0.8.
PIPELINE = Rule(width=5, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates, once. Rows without doc_id link with nothing and stay; rows that
    share a doc_id but not the text are judged each by its text; an empty table stays empty."""
    longer = "_" * max(map(len, docs.columns))  # names that no column of docs has
    by = [f"{longer}id", f"{longer}x"]
    found = kept_only(spark, lambda: _joined(docs, "doc_id", "text", PIPELINE).where("id IS NOT NULL"))
    rows = found.select(F.col("id").alias(by[0]), F.col("x").alias(by[1]), "top")
    gone = written(rows.where((F.col("top")["id"] != F.col(by[0])) | (F.col("top")["x"] != F.col(by[1]))).select(*by).distinct())
    gone = F.broadcast(gone) if gone.count() <= SENT_KEYS else gone  # else the texts must move
    again = rows.groupBy(*by).count().where("count > 1").drop("count")
    out = docs.select("*", F.col("doc_id").cast("long").alias(by[0]), text_hash("text").alias(by[1])).join(gone, by, "left_anti")
    if again.limit(1).count():  # rows that repeat a document: only those are brought together
        out = out.join(again, by, "left_anti").unionByName(out.join(again, by, "left_semi").dropDuplicates(by))
    return out.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS nb FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * nb >= 90 * (a.n + b.n - nb)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r.y) FROM r WHERE r.x = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
