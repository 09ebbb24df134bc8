"""The pipeline's stages, each against a brute-force version of what it decides, on a small corpus with planted cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolake.llm import bpe, common, jaccard, language, mixing, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """300 documents and their labels, with planted rows: no letters, copies exact and near, toxic copies, a null key, repeated rows."""
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS).orderBy("doc_id").limit(1000).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [tuple(r) for r in table if r["doc_id"] in labels][:300]
    good = [r for r in rows if not labels[r[0]] and len(r[1].split()) > 60]
    for i, r in enumerate(good[:8]):
        w = r[1].split()
        w[len(w) // 2] = "changed"
        rows += [(10_000 + i, r[1], r[2], "copies", r[4]), (20_000 + i, " ".join(w), r[2], "copies", 0)]
    rows += [(30_000, None, None, None, None), (30_001, "12 34 ...", "en", "x", 0), (30_002, "", "en", "x", 0), (None, good[9][1], "en", "x", 0), rows[0], rows[0]]
    rows += [(2**60 + k, " ".join(rng.choices(good[10][1].split(), k=80)), "en", None, 2**60 + k) for k in (1, 3)]
    spark.createDataFrame(rows, SCHEMA).withColumn("_at", F.monotonically_increasing_id()).repartition(4).drop("_at").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(v), 1) for k, v in labels.items()], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_language_stage_keeps_what_a_plain_softmax_is_sure_of(spark, docs, sf_dir):
    model = language.train(docs)

    def plain(text):
        at = [b for w in language.letters(text) for b in language.subwords(w)]
        if not at:
            return "und", 0.0
        z = (sum(model.table[b].astype(float) for b in at) / len(at) + model.bias) * model.sharpness
        p = np.exp(z - z.max())
        return model.languages[int(p.argmax())], float(p.max() / p.sum())

    for r in language.identify(docs, model).collect():
        lang, score = plain(r["text"])
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, abs_tol=1e-9) and r["rejected"] == (lang == "und" or score < model.threshold)
    want = Counter({k: n for k, n in rows_of(docs).items() if (p := plain(k[1]))[0] != "und" and p[1] >= model.threshold})
    kept = rows_of(language.stage(spark, docs, sf_dir))
    assert kept == want and sum(kept.values()) >= 0.95 * sum(rows_of(docs).values())


def test_toxicity_stage_keeps_what_plain_marginals_clear(spark, docs, sf_dir):
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def plain(text):
        tokens = (text or "").split()
        top, mass = 0.5, 0.0  # no tokens: as the operator's docstring says, no evidence
        x = toxicity._aggregate(np.zeros(0), np.array([0]), np.array([0]))[0]
        if tokens:
            e = np.array([[sum(float(model.weights[b]) for b in toxicity.buckets(t)) for t in tokens]])
            p, _ = toxicity._forward_backward(np.clip(e, -30, 30), np.ones(e.shape, bool), model.start, model.move)
            top, mass = min(max(p.max(), 1e-4), 1 - 1e-4), p.sum()
            x = np.array([1, math.log(top / (1 - top)), math.log(mass + 0.01)])
        return 1 / (1 + math.exp(-float(np.clip(x @ model.blend, -30, 30))))

    for r in toxicity.score(docs, model).collect():
        assert math.isclose(r["score"], plain(r["text"]), rel_tol=1e-4, abs_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
    kept = rows_of(toxicity.stage(spark, docs, sf_dir))
    scores = {k: plain(k[1]) for k in rows_of(docs)}
    sure = [k for k, s in scores.items() if abs(s - 0.5) > 1e-3]
    assert all((k in kept) == (scores[k] < 0.5) for k in sure) and all(n == rows_of(docs)[k] for k, n in kept.items())


def plain_groups(rows, width, percent):
    """Smallest (id, text's place) that links reach, by comparing all pairs."""
    sets = []
    for r in rows:
        w = common.words(r[1])
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    top[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("sent", [True, False])
def test_near_duplicates_stage_keeps_one_of_each_group(spark, docs, sf_dir, monkeypatch, sent):
    if not sent:  # the ways without a broadcast, and components dealt finely
        for name, value in (("SENT", 0), ("SENT_KEYS", 0), ("PART", 3)):
            monkeypatch.setattr(jaccard, name, value)
    clashing = ["_id", "_x", "id", "x", "rep", "t", "top", "count", "c", "n"]
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    groups = plain_groups(rows, 5, 80)
    by = defaultdict(list)
    for r, g in zip(rows, groups):
        by[g].append(r)
    out = jaccard.stage(spark, docs.withColumns({c: F.lit(c) for c in clashing}), sf_dir)
    assert out.columns == COLUMNS + clashing
    kept = rows_of(out)
    for group in by.values():
        if group[0][0] is None or not common.words(group[0][1]):
            assert all(kept[r] >= 1 for r in group)
            continue
        here = [r for r in set(group) if kept[r]]
        assert len(here) == 1 and kept[here[0]] == 1 and here[0][0] == min(r[0] for r in group)
    assert any(len(g) > 2 for g in by.values())


def test_texts_that_share_a_key_are_judged_each_by_its_own(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = spark.createDataFrame([(5, a, "", "", 0), (5, b, "", "", 0), (7, b + " more", "", "", 0), (8, a, "", "", 0), (9, c, "", "", 0)], SCHEMA)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect())
    assert got == [(5, 38, 5), (5, 38, 5), (7, 39, 5), (8, 38, 5), (9, 38, 9)]
    assert rows_of(jaccard.stage(spark, df, "")) == Counter([(5, a, "", "", 0), (5, b, "", "", 0), (9, c, "", "", 0)])


def test_mixing_stage_loses_nothing_and_packing_stage_packs_every_row(spark, docs, sf_dir):
    mixed = common.written(mixing.stage(spark, docs, sf_dir))
    assert mixed.columns == COLUMNS and set(rows_of(mixed)) == set(rows_of(docs)) and all(rows_of(mixed)[k] >= n for k, n in rows_of(docs).items())
    encode = bpe.load(packing.tokenizer_path()).encode
    want = Counter()
    for (k, t, *_), n in rows_of(mixed).items():
        want[k] += n * (len(encode(t or "")) + 1)
    got = Counter()
    for r in packing.stage(spark, mixed, sf_dir).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_is_its_stages_in_turn(spark, docs, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, kept, sf_dir))
        assert kept.columns == COLUMNS
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in kept.collect()}
    ids = {r["doc_id"] for r in out}
    assert not ids & {30_000, 30_001, 30_002} and not ids & {10_000 + i for i in range(8)} and {2**60 + 1, 2**60 + 3} & ids


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, sf_dir)
        assert got.count() == 0 and (name == "packing" or got.columns == COLUMNS)
