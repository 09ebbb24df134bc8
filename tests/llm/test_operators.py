"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from chronolake.llm import bpe, common, embedding_dedup, jaccard, kernels, language, lattice, lm_scoring, mixing, packing, sharding, topk, toxicity, url_filter

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, other scripts."""
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "a b", "en", "a", 3), (4, "A  b", None, "b", 4), (5, "123 456", "en", None, 7), (6, "x", "fr", "b", 1),
            (7, "the of and " * 30_000, "en", "a", 330_000), (8, "日本語 テキスト と x <|endoftext|>", "ja", "b", 9), (None, "no key here", "en", "a", 11), (3, "a b", "en", "a", 3), (9, "y" * 50_000, "de", "c", 50_000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(key, n):
    return key is not None and zlib.crc32(str(key).encode()) % n == 0


def test_keys_beside_a_null_stay_exact(spark):
    """64-bit keys that a float cannot hold, and one that differs from its neighbour by 2 only, beside a null key and a null count."""
    big = [2**60 + 1, 2**60 + 3, -(2**63), 2**63 - 1, None, 7]
    rows = [(k, f"a text of some words for number {i} here and there", "en", "a", None if i == 0 else 2**60 + i) for i, k in enumerate(big)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    model = language.train(df)
    found = language.identify(df, model).collect()
    assert {(r["doc_id"], r["n_chars"]) for r in found} == {(r[0], r[4]) for r in rows}
    field = toxicity.train(df, spark.createDataFrame([(2**60 + 1, 1), (2**60 + 3, 0)], "doc_id long, toxic int"))
    assert {(r["doc_id"], r["n_chars"]) for r in toxicity.score(df, field).collect()} == {(r[0], r[4]) for r in rows}
    assert Counter(r["doc_id"] for r in lm_scoring.score(df).collect()) == Counter(big)
    assert {r["doc_id"] for r in packing.pack(df, packing.tokenizer_path()).collect()} == set(big)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect()} == {(k, k) for k in big}
    for stage in (jaccard.stage, mixing.stage):
        assert {r["doc_id"] for r in stage(spark, df, DIR).collect()} == set(big)
    shards = {r["doc_id"] for r in sharding.shard(df, 8).collect()}
    assert shards == set(big)


def test_samples_keep_small_classes(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") < 30, "rare").when(F.col("id") < 40, None).otherwise("much").alias("c"))
    some, sizes = common.stratified_sample(df, "k", "c", 1000, "x")
    got = Counter(r["c"] for r in some.collect())
    assert sizes == {"rare": 30, None: 10, "much": 19_960} and got["rare"] == 30 and got[None] == 10 and 800 < got["much"] < 1100
    assert common.stratified_sample(df, "k", "c", 50_000, "x")[0].count() == 20_000 and common.stratified_sample(df.limit(0), "k", "c", 5, "x")[0].count() == 0


def test_scoring(spark, docs, odd, empty):
    both = docs.unionByName(odd)
    got = lm_scoring.score(both).collect()
    rows = [(r["doc_id"], common.words(r["text"])) for r in both.collect()]
    count = Counter()
    for k, w in rows:
        if not held(k, 10):
            count.update(w)
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    base = sorted((k is None, k or 0, len(w) + 1, sum(count[x] > 0 for x in [*w, "end"]), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "end"]), 3)) for k, w in rows)
    assert base == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) and r["train_tokens"] == n and r["held_out"] == held(r["doc_id"], 10) for r in got)
    far = lm_scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert far[0] > far[1]  # held-out texts are likelier than by their words alone
    assert lm_scoring.score(empty).count() == 0


def test_scoring_joins_the_words_that_are_not_sent(docs, monkeypatch):
    want = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "SENT_WORDS", 500)
    for r in lm_scoring.score(docs).collect():
        assert r["n_known"] == want[r["doc_id"]]["n_known"] and abs(r["base_score"] - want[r["doc_id"]]["base_score"]) < 1e-6


def test_scoring_joins_the_pairs_that_are_not_sent(docs, monkeypatch):
    want = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "SENT_PAIRS", 50)
    for r in lm_scoring.score(docs).collect():
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-5)


def test_scoring_counts_and_trains_on_all_documents(spark, docs):
    path = packing.tokenizer_path()
    texts = docs.select("doc_id", F.col("text").alias("t")).orderBy("doc_id").limit(60).collect() + [(1000, None), (1001, "")]
    frame = spark.createDataFrame([tuple(r) for r in texts], "k long, t string").repartition(3)
    want = Counter()
    for _, t in texts:
        ids = [lm_scoring.END, *bpe.load(path).encode_words(common.words(t))[0], lm_scoring.END]
        want.update(int(a) << 17 | int(b) for a, b in zip(ids, ids[1:]))
    table = lm_scoring.counts(frame, path)
    assert {r["key"]: r["n"] for r in table.where("kind = 1").collect()} == want
    model = lm_scoring.gathered(table, np.random.default_rng(0))
    model.out[:] = np.random.default_rng(1).normal(0, 0.1, model.out.shape)
    start = model.own.copy()
    model = lm_scoring.refined(frame, model, path)
    symbol, given = model.tables()
    seen = {int(given[k >> 17]) for k in want}  # every id of every document, but none else, has learnt
    assert {int(i) for i in np.flatnonzero((model.own != start).any(1))} - {len(model.own) - 1} == seen - {len(model.own) - 1}


def test_attention_windows_score_each_id_once_and_causally():
    rng = np.random.default_rng(0)
    pairs = {(int(a), int(b)): int(n) for a, b, n in zip(*rng.integers(0, 300, (2, 4000)), rng.integers(1, 9, 4000))}
    keys = sorted([a << 17 | b for a, b in pairs] + [lm_scoring.NONE << 17 | b for b in range(300)] + [a << 17 | lm_scoring.NONE for a in range(300)])
    model = lm_scoring.started(np.array(keys), np.array([pairs.get((k >> 17, k & (2**17 - 1)), 3) for k in keys]), rng)
    model.out[:] = rng.normal(0, 0.3, model.out.shape)
    model.near[:] = rng.normal(0, 0.3, model.near.shape)
    scorer, b = lm_scoring.Scorer(model), lm_scoring.BLOCK
    texts = [np.append(rng.integers(0, 300, n), lm_scoring.END) for n in (0, 1, b - 1, b, 5 * b + 3)]
    together = scorer.texts(texts)
    assert np.allclose(together, [scorer.texts([t])[0] for t in texts], rtol=1e-5)

    def slow(ids):
        given = [scorer.given[x] for x in [lm_scoring.END, *ids[:-1]]]
        total, d = 0.0, lm_scoring.WIDTH // lm_scoring.HEADS
        for i, x in enumerate(ids):
            at = range(max(0, i // b * b - b), i + 1)
            h = model.own[given[i]].astype(float).copy()
            for head in range(lm_scoring.HEADS):
                part = slice(head * d, head * d + d)
                w = np.array([math.exp(model.query[given[i], part] @ model.key[given[j], part] / math.sqrt(d) + model.near[head, i - j]) for j in at])
                h[part] += sum(a * model.value[given[j], part] for a, j in zip(w / w.sum(), at))
            logits = h @ model.out + model.direct[min(given[i], len(model.inputs))]
            total += (logits[scorer.symbol[x]] - math.log(np.exp(logits).sum())) / math.log(10)
            if scorer.symbol[x] == len(model.heads):
                total += scorer.others(np.array([[lm_scoring.END, *ids[:-1]][i]]), np.array([x]))[0]
        return total

    assert np.allclose(together, [slow(t.tolist()) for t in texts], rtol=1e-4)


def test_training_follows_the_slope_of_the_scores():
    rng = np.random.default_rng(0)
    pairs = {(int(a), int(b)): int(n) for a, b, n in zip(*rng.integers(0, 300, (2, 4000)), rng.integers(1, 9, 4000))}
    keys = np.array(sorted(a << 17 | b for a, b in pairs))
    model = lm_scoring.started(keys, np.array([pairs[int(k) >> 17, int(k) & (2**17 - 1)] for k in keys]), rng)
    for name in lm_scoring.TRAINED:
        getattr(model, name)[:] = rng.normal(0, 0.3, getattr(model, name).shape)
    b = lm_scoring.BLOCK
    texts = [rng.integers(0, 300, n) for n in (1, b, 5 * b + 3, (lm_scoring.CHUNK + 2) * b)]
    target, before, first = lm_scoring.blocks(texts)
    grads = lm_scoring.Adam(model).grads(target, *lm_scoring.Scorer(model).numbers(target, before, first))
    cost = lambda: -math.log(10) * lm_scoring.Scorer(model).texts(texts).sum() / sum(map(len, texts))
    for name in lm_scoring.TRAINED:
        slope, at = grads[name], getattr(model, name)
        start, size, ends = at.copy(), float(np.sqrt((slope.astype(float) ** 2).sum())), []
        for side in (0.02, -0.02):
            at[:] = start + np.float32(side / size) * slope
            ends.append(cost())
        at[:] = start
        assert math.isclose((ends[0] - ends[1]) / 0.04, size, rel_tol=0.02), name


@pytest.mark.parametrize("installed", [True, False])
def test_kernels_are_numpys(installed, monkeypatch):
    """Whole buffers, their first rows, and rows that repeat; with and without onnxruntime."""
    if installed:
        pytest.importorskip("onnxruntime")
    else:
        monkeypatch.setattr(kernels, "onnxruntime", None)
    rng = np.random.default_rng(0)
    normal = lambda *s: rng.normal(-1, 3, s).astype(np.float32)
    for rows in (40, 7):
        x = normal(40, 2, 13)
        want = np.concatenate([np.exp(x[:rows].astype(float)), x[rows:]])
        kernels.Exp(x)(rows)
        assert np.allclose(x, want, rtol=1e-6)
        a, b, y = normal(40, 5), normal(5, 13), normal(40, 13)
        want = y.astype(float)
        want[:rows] += a[:rows].astype(float) @ b
        kernels.AddProduct(a, b, y)(rows)
        assert np.allclose(y, want, rtol=1e-4, atol=1e-4)
        assert np.allclose(kernels.Product(a, y)(rows), a[:rows].T.astype(float) @ y[:rows], rtol=1e-4, atol=1e-3)
    at, x = rng.integers(0, 6, (30, 4)), normal(30, 4, 3)
    want = np.zeros((9, 3))
    np.add.at(want, at.reshape(-1), x.reshape(-1, 3))
    assert np.allclose(kernels.by_row(at, x, 9), want, rtol=1e-4, atol=1e-4)
    with pytest.raises(ValueError) if installed else nullcontext():
        kernels.Exp(normal(4, 6)[:, ::2])


def test_words_split_at_once_are_those_of_each_text(odd, docs):
    texts = [*[r["text"] for r in odd.collect()], *[r["text"] for r in docs.limit(40).collect()], " a b", "a b ", "A  b\x0bc\x0cd\re", "\u3000x\x1cy\x85 \xa0z", "\x00 q"]
    encoder = bpe.load(packing.tokenizer_path())
    known = lm_scoring._Ids(encoder)
    for part in (texts, texts[:3], [], texts[::-1]):
        at, many, distinct = lm_scoring._coded(pa.array(part, pa.string()))
        assert many.tolist() == [len(common.words(t)) for t in part]
        assert [distinct[i] for i in at] == [w for t in part for w in common.words(t)]
        for t, w in zip(part, known.numbered(pa.array(part, pa.string()))[0], strict=True):
            assert known.of(w).tolist() == [*encoder.encode_words(common.words(t))[0], lm_scoring.END]


def test_words_of_later_parts_of_a_batch_are_theirs(spark):
    """More rows in one batch than are split at once: all but the first part begin inside the batch's buffers (a null would have them copied)."""
    texts = ["" if i % 7 == 0 else f" Word{i % 50} w{i}  X\t" + "y " * (i % 5) for i in range(2 * lm_scoring.SPLIT + 300)]
    for kind in (pa.string(), pa.large_string()):
        for lo in range(0, len(texts), lm_scoring.SPLIT):
            part = texts[lo : lo + lm_scoring.SPLIT]
            at, many, distinct = lm_scoring._coded(pa.array(texts, kind).slice(lo, lm_scoring.SPLIT))
            assert many.tolist() == [len(common.words(t)) for t in part]
            assert [distinct[i] for i in at] == [w for t in part for w in common.words(t)]
    count = Counter()
    for k, t in enumerate(texts):
        if not held(k, 10):
            count.update([*common.words(t), "end"])
    n, v = sum(count.values()), len(count)
    got = lm_scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == len(texts)
    for r in got:
        w = [*common.words(texts[r["doc_id"]]), "end"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 10), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)


def test_bpe_is_the_tokenizers_one(odd, docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    theirs, ours = Tokenizer.from_file(path), bpe.load(path)
    for r in [*odd.where("text IS NOT NULL AND doc_id <> 9").collect(), *docs.limit(50).collect()]:
        assert ours.encode(r["text"]) == theirs.encode(r["text"], add_special_tokens=False).ids
        w = common.words(r["text"])
        ids, opens = ours.encode_words(w)
        assert opens.sum() == len(w)
    assert ours.encode_words([])[0].size == 0


def test_urls(spark):
    urls = [None, "", "nothing", "http://ORG/x", "http://a.example.org/es/1?x", "http://example.org/en/12", "http://example.org/en/2", "https://xcom/fr/1", "http://m.com/fr/", "http://m.com/de", "http://m.net/de/#f",
            "http://a/b/://c.org/x", "http://www.cheap-pills.net/", "http://a.net/Casino.html", "http://pillsx.net", "http://é.org/é\n/x", "http://x.org?y=/", "http://spam-x-farm.net/a", "http://spamxfarm.net/a", "http://a.net/b//c", "http://a.net/Setup.EXE", "http://a.net/exe", "http://a.net/x.exe/y", "http://a.net/tag/a/page/1/page/2",
            "http://-a.net/", "http://a.net/KASINO/\u212aasino", "http://a.net/" + "x/" * 60_000 + "casino/" + "y" * 60_000, "http://a.net/wp-login.php", "http://a.net/cheap-blue-pills/", "http://a.net/cheap-bluepills/"]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)] + [(3, "http://ORG/x", "clash", 1)], "page_id long, url string, verdict string, host int")
    for r in url_filter.judge(df, url_filter.HOST_RULES + url_filter.PATTERN_RULES).collect():
        u = urls[r["page_id"]] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
            host, path = rest[:at].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[at:].split("?")[0].split("#")[0]
        assert (r["host"], r["path"]) == (host, path)
        fits = [(len(h + p), h + p, a) for h, p, a in [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert r["rule"] == (best and best[1])
        if best:
            assert r["verdict"] == best[2]
    # patterns by a plain scan of all of them, with another regular expression engine
    for r in url_filter.judge(df, url_filter.PATTERN_RULES).collect():
        u = urls[r["page_id"]] or ""
        fits = [p.name for p in url_filter.PATTERN_RULES if re.search(p.pattern.replace("\\z", "\\Z"), r["host"] + r["path"], re.ASCII)]
        assert r["pattern"] == min(fits, default=None) and r["verdict"] == ("block" if fits else "allow") and r["rule"] is None
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, url_filter.HOST_RULES + url_filter.PATTERN_RULES).collect()}
    assert (got[12], got[13], got[14]) == ("block", "block", "allow")
    assert url_filter.judge(df.limit(0), url_filter.HOST_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(200, 8))
    c = lattice.cells(x, 3) / 2
    whole = np.all(c == np.rint(c), axis=2) | np.all(c - 0.5 == np.rint(c - 0.5), axis=2)
    assert whole.all() and np.all(c.sum(2) % 2 == 0)
    assert ((x - c[:, 0]) ** 2).sum(1).max() <= 1 + 1e-9  # the covering radius is one


@pytest.mark.parametrize("chunk", [1024, 8])
def test_embeddings_against_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([base, base[:20], base[:1] + rng.normal(size=(40, 64)) * 0.05, base[20:40] + rng.normal(size=(20, 64)) * 0.1]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, [], 1), (504, [1.0, None], 1), (505, [1.0, 0.0], 2), (506, [2.0, 0.0], 2), (None, x[0].tolist(), 3)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int"), chunk=chunk).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    for i in range(len(x)):
        assert got[i]["n_links"] == link[i].sum() - 1
        reach, new = {i}, {i}
        while new:
            new = {int(j) for k in new for j in np.flatnonzero(link[k])} - reach
            reach |= new
        assert got[i]["component_id"] == min(reach) and got[i]["kept"] == (min(reach) == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (500, 501, 502, 503, 504))
    assert got[505]["n_links"] == 1 and got[506]["component_id"] == 505 and got[None]["n_links"] == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    t = embedding_dedup.Tables()
    for t, cosine, least in ((t, 0.951, 0.9), (t, 0.97, 0.98), (t.suited(10**8), 0.951, 0.9), (t.suited(10**8), 0.97, 0.98)):
        ka, kb = t.keys(a), t.keys(cosine * a + math.sqrt(1 - cosine**2) * b)
        met = (ka == kb[:, :, :1]).any((1, 2)) | (kb == ka[:, :, :1]).any((1, 2))
        assert met.mean() >= least


def test_links_do_not_depend_on_how_many_vectors_there_are(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9502 * a + math.sqrt(1 - 0.9502**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    links = lambda: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    few, count = links(), DataFrame.count
    assert sum(n for n, _ in few.values()) >= 0.95 * len(few)
    monkeypatch.setattr(type(df), "count", lambda self: count(self) and count(self) + 10**8)
    assert links() == few


def test_shards(spark, odd, empty):
    df = odd.withColumn("shard", F.lit("clash"))
    rows = sharding.shard(df, 8).collect()
    assert len(rows) == odd.count()
    text = defaultdict(list)
    for r in odd.collect():
        text[r["doc_id"]].append((r["text"] or "").encode())
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) in [(len(t) + 1, zlib.crc32(t)) for t in text[r["doc_id"]]]
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    eight, nine = sharding.shard(many, 8).collect(), {r["doc_id"]: r["shard"] for r in sharding.shard(many, 9).collect()}
    assert all(r["grown_shard"] == nine[r["doc_id"]] for r in eight)
    assert max(Counter(r["shard"] for r in eight).values()) < 1.1 * 20_000 / 8 and abs(sum(v == 8 for v in nine.values()) - 20_000 / 9) < 300
    assert sharding.shard(empty, 8).count() == 0


def chained(*parts):
    """What Spark's xxhash64 of these columns is: each value is hashed with what came before as its seed."""
    h = 42
    for p in parts:
        if p is not None:
            raw = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<q", p)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("shards", [1, 2, 8, 1000])
def test_shards_are_those_of_a_plain_jump_hash(spark, shards):
    def plain(key):
        b, j = 0, 0
        while j < shards:
            b = j
            digest = hashlib.md5((f"{key}:{j}" if key is not None else str(j)).encode()).hexdigest()
            j = max(int(min((j + 1) / ((int(digest[:13], 16) + 1) / 2**52), 2.0**52)), j + 1)
        return b, shards if j == shards else b

    keys = [*range(2000), -1, 2**60 + 1, 2**63 - 1, None]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard(df, shards).collect()}
    assert got == {k: plain(k) for k in keys}


def test_mixing_realises_the_blocks_of_a_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["big", "mid", "small", None][int(np.searchsorted([0.7, 0.92, 0.98], rng.random()))]) for i in range(1500)]
    rows += [(7, "again " * 9, "big"), (7, "again " * 9, "big"), (None, "no key", "mid"), (5000, None, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target, size = mixing.Target(repetition=3.0), 64
    got = Counter((r["doc_id"], r["_tokens"], r["source"], r["_epoch"]) for r in mixing.mix(df, target, block_tokens=size).collect())
    tokens = lambda t: len((t or "").split()) + 1
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += tokens(t)
    share = {s: n / sum(total.values()) for s, n in total.items()}
    low, high = 0.0, 1.0
    for _ in range(60):  # the smallest exponent that keeps the spread of uses within the limit
        a = (low + high) / 2
        uses = [x ** (a - 1) for x in share.values()]
        low, high = (low, a) if max(uses) / min(uses) <= target.repetition else (a, high)
    z = sum(x**high for x in share.values())
    spend = sum(total.values()) * z * max(x ** (1 - high) for x in share.values())
    want = Counter()
    for s, t in total.items():
        passes = share[s] ** high / z * spend / t
        whole, blocks = int(passes + 1e-9), max(64, -(-t // size))
        turn = lambda e, b: chained((0,), (e,), s, b) % 2**24  # noqa: E731, B023
        mine = [(k, tokens(x), signed(chained((0,), "block", k)) % blocks) for k, x, y in rows if y == s]
        sizes = Counter()
        for _, n, b in mine:
            sizes[b] += n
        used, sofar = set(), 0
        for b in sorted(sizes, key=lambda b: (turn(whole, b), b)):
            if sofar < (passes - whole) * t - 0.5:
                used.add(b)
            sofar += sizes[b]
        for k, n, b in mine:
            for e in range(whole + (b in used)):
                want[(k, n, s, e)] += 1
    assert sum(((got - want) + (want - got)).values()) <= 0.002 * sum(want.values())  # a block at the very edge may fall either way
    assert got.keys() >= {(k, tokens(t), s, 0) for k, t, s in rows}


def test_lists_stop_early_where_scores_allow_and_never_else():
    rng = np.random.default_rng(0)
    skewed = np.floor(64 * rng.exponential(1, (4000, 4)) ** 3)
    for x, early in ((skewed, True), (np.floor(64 * rng.uniform(-1, 1, (700, 48))), False), (np.zeros((50, 3)), True), (np.ones((5, 2)), True)):
        ids = rng.permutation(len(x)) * 3
        got = list(topk.Lists(x).top(x[:40], ids[:40], ids, 20))
        assert sorted(g[0] for g in got) == list(range(min(40, len(x))))
        for q, best, score, depth in got:
            s = x @ x[q]
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:20]
            assert best.tolist() == ids[order].tolist() and score.tolist() == s[order].tolist()
        assert (np.mean([g[3] for g in got]) < 0.5) == early or len(x) < 100


@pytest.mark.parametrize("low", [-1.0, -0.01])
def test_topk_against_brute_force(spark, low):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((300, 16)) < 0.3, 0, rng.uniform(low, 1, (300, 16))).astype(np.float32)
    x[100:140] = x[7]
    x[3] = 0
    rows = [(i, v.tolist(), 5) for i, v in enumerate(x)] + [(1000, None, 5), (1020, [None] * 16, 5), (1040, [float("inf")] * 16, 5), (None, x[0].tolist(), 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in topk.search(df, lambda i: i % 20 == 0, candidates=64, queries=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.floor(x.astype(float) * 64).astype(int)
    want = {q: [(i, int(v[i] @ v[q])) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-int(v[i] @ v[q]), i))[:20]] for q in range(0, 300, 20)}
    assert got == want
    few = topk.search(df.where("vec_id < 5"), lambda i: i % 20 == 0)
    assert few.count() == 4 and topk.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_language(spark, docs, odd, empty):
    model = language.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = language.identify(docs, model).where(common.held_out("doc_id", 5)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) and sum(r["rejected"] for r in found) <= 0.02 * len(found) + 1
    rows = language.identify(odd.withColumn("score", F.lit("clash")), model).collect()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2, 5)) and 0 <= r["score"] <= 1 for r in rows)
    none = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_toxicity(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.where(common.held_out("doc_id", 5)), model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    bad, good = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) >= 0.85 * len(bad) and sum(r["predicted"] for r in good) <= 0.02 * len(good)
    hit = next(r for r in bad if r["spans"] and r["lang"] == "en")
    assert all(hit["text"][s["start"] : s["end"]].strip() for s in hit["spans"])
    rows = toxicity.score(odd.withColumn("predicted", F.lit("clash")), model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(odd, toxicity.train(empty, labels)).count() == odd.count()


def test_field_marginals_against_enumeration():
    rng = np.random.default_rng(6)
    move = rng.normal(size=(2, 2))
    move[0, 0] = 0
    lengths = [1, 7, 3, 9, 300]
    e = rng.normal(0, 2, sum(lengths))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, at = toxicity.marginals(e, first, -0.4, move), 0
    for n in lengths:
        if n < 10:
            z, m = 0.0, np.zeros(n)
            for bits in range(2**n):
                y = [(bits >> i) & 1 for i in range(n)]
                w = math.exp(-0.4 * y[0] + sum(e[at + i] * y[i] for i in range(n)) + sum(move[y[i - 1], y[i]] for i in range(1, n)))
                z, m = z + w, m + w * np.array(y)
            assert np.allclose(p[at : at + n], m / z)
        else:
            q, _ = toxicity._forward_backward(e[None, at : at + n], np.ones((1, n), bool), -0.4, move)
            assert np.allclose(p[at : at + n], q[0])
        at += n


def test_mixing(spark, docs, odd, empty):
    clashing = ["w", "blocks", "whole", "last", "passes", "p_source", "_block", "_c0", "_key", "_source"]
    mixed = mixing.mix(docs.withColumns({"_weight": F.lit("clash"), **{c: F.lit(c) for c in clashing}}), mixing.Target(repetition=2.0))
    assert mixed.select(*clashing).distinct().collect() == [tuple(clashing)]
    r = mixed.collect()
    assert {x["doc_id"] for x in r} == {x["doc_id"] for x in docs.collect()}  # nothing is lost without a budget
    used, tokens = Counter(x["source"] for x in r), defaultdict(int)
    for x in r:
        tokens[x["source"]] += x["_tokens"]
    total = sum(tokens.values())
    assert max(abs(tokens[x["source"]] / total - x["_weight"]) for x in r) < 0.03 and len(used) == 20
    table = mixing.shares(docs.select("source", mixing.token_count(F.col("text")).alias("tokens")))
    t = np.array([x["tokens"] for x in table.collect()], float)
    s = t / t.sum()
    want = math.log(20) - 0.01
    a = mixing.exponent(table, int(t.sum()), mixing.Target(entropy=want))
    w = s**a / (s**a).sum()
    assert abs(-(w * np.log(w)).sum() - want) < 1e-5
    once = mixing.mix(odd, mixing.Target(repetition=1.0)).collect()
    assert len(once) == odd.count() and mixing.mix(empty, mixing.Target(repetition=2.0)).count() == 0
    half = mixing.mix(docs, mixing.Target(repetition=1.0), budget=int(t.sum() / 2)).agg(F.sum("_tokens")).first()[0]
    assert 0.4 < half / t.sum() < 0.62


def test_mixing_stage_interleaves_and_meets_the_target(spark, tmp_path):
    source = F.expr("CASE WHEN id < 4000 THEN 'a' WHEN id < 7900 THEN 'b' ELSE 'c' END")
    lying = spark.range(0, 8000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"), F.lit("en").alias("lang"), source.alias("source"), F.lit(18).cast("long").alias("n_chars"))
    mixing.stage(spark, lying, DIR).write.parquet(f"file://{tmp_path}/mixed")
    rows = spark.read.parquet(f"file://{tmp_path}/mixed").select("doc_id", "source", F.input_file_name().alias("file")).collect()
    used, files = Counter(r["source"] for r in rows), defaultdict(list)
    assert len({r["doc_id"] for r in rows}) == 8000 and used["a"] == 4000 and 3.5 <= used["c"] / 100 <= 4.1
    for r in rows:
        files[r["file"]].append(r["source"])
    for got in files.values():  # input lying source by source comes out mixed, in every part of every file
        for lo in range(0, len(got) - 999, 500):
            assert {"a", "b"} <= set(got[lo : lo + 1000])


def test_packing_is_an_exact_round_trip(spark, docs, odd, empty):
    both = docs.unionByName(odd)
    pieces = packing.pack(both.repartition(12).withColumn("length", F.lit("clash")), packing.tokenizer_path()).collect()
    encode = bpe.load(packing.tokenizer_path()).encode
    want = Counter()
    for r in both.collect():
        want[(r["doc_id"], zlib.crc32(np.array([*encode(r["text"] or ""), 1], "<u4").tobytes()))] += 1
    at = defaultdict(list)
    for p in pieces:
        at[p["doc_id"]].append(p)
    texts = defaultdict(list)
    for r in both.collect():
        texts[r["doc_id"]].append([*encode(r["text"] or ""), 1])
    for k, own in at.items():
        assert sum(p["length"] for p in own) == sum(map(len, texts[k]))
        for p in own:
            assert any(p["doc_tokens"] == len(t) and p["ids_crc32"] == zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for t in texts[k])
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    used = 0
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= packing.CAPACITY
        used += end
    assert used > 0.97 * len(seqs) * packing.CAPACITY
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def test_cuts_and_classes():
    for n in [*range(1, 5000, 7), 2048, 4096]:
        c = packing.cuts(n)
        assert sum(c) == n and max(c) <= packing.CAPACITY and min(c) > 0


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("chunk", [1_000_000, 400])
def test_jaccard_against_brute_force(spark, docs, odd, width, percent, chunk):
    import random

    rng = random.Random(1)
    extra = []
    for i, r in enumerate(docs.where("doc_id >= 20").orderBy("doc_id").limit(12).collect()):
        w = (r["text"] or "").split()[:120]
        for j in range(4):
            v = list(w)
            for _ in range(j):
                if v:
                    v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            extra.append((10_000 + 10 * i + j, " ".join(v), "en", "a", 0))
    both = docs.where("doc_id >= 20").unionByName(odd).unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("n_shingles", F.lit("clash"))
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.join(both, rule=jaccard.Rule(width, percent), chunk=chunk).collect()}
    sets = {}
    for r in both.collect():
        w = common.words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    keys = [k for k in sets if k is not None]
    link = {k: [j for j in keys if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= percent * len(sets[k] | sets[j])] for k in keys}
    for k in keys:
        reach, new = {k}, {k}
        while new:
            new = {j for x in new for j in link[x]} - reach
            reach |= new
        assert got[(k, len(sets[k]))] == min(reach)
    assert got[(None, len(sets[None]))] is None


def test_heap_merge_against_counting():
    rng = np.random.default_rng(1)
    for least in (1, 2, 3, 6):
        for n in (0, 1, 5, 12):
            lists = [sorted(rng.choice(40, rng.integers(0, 25), replace=False).tolist()) for _ in range(n)]
            count = Counter(x for one in lists for x in one)
            found, many = jaccard.merged(lists, least)
            assert dict(zip(found.tolist(), many.tolist())) == {x: k for x, k in count.items() if k >= least} and sorted(found.tolist()) == found.tolist()


def test_jaccard_of_an_empty_table(empty):
    assert jaccard.join(empty).count() == 0


def test_embeddings_of_an_empty_table_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-5.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0 and topk.search(df.limit(0), lambda i: i % 2 == 0).count() == 0
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert topk.search(df, lambda i: i == 2).count() == 3


def test_components_of_chains_and_empties(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert common.components(e.limit(0)).count() == 0
