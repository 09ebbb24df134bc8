"""Every registered query of the store's operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from chronolake.plans import oracles, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, duck.sql(f"SELECT {names} FROM ({oracles.ORACLES[name]}) q").fetchall()))


def test_key_lookup_reaches_the_scan(spark):
    plan = queries.QUERIES["get_point"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "user_id" in plan


def test_bloom_has_few_false_positives(spark):
    from pyspark.sql import functions as F

    from chronolake.functions import codec as C

    keys = spark.range(1000).select(F.format_string("key%05d", "id").alias("k"))
    absent = spark.range(10_000).select(F.format_string("absent%05d", "id").alias("k"))
    bits, hashes = C.bloom_shape(1000)
    have = {r[0] for r in keys.select(F.explode(C.bloom_probes(F.col("k"), bits, hashes))).collect()}
    hits = sum(set(r[0]) <= have for r in absent.select(C.bloom_probes(F.col("k"), bits, hashes)).collect())
    assert hits < 300


def test_intervals_and_overlaps_against_all_pairs(spark):
    import random

    from chronolake.operators import runs

    rng = random.Random(2)
    files = [(i, *sorted(rng.choices("abcdefghijkl", k=2))) for i in range(60)] + [(60, "a", "l"), (61, "c", "c"), (62, "c", "c")]
    df = spark.createDataFrame(files, "file_number long, smallest string, largest string").repartition(5)
    meet = lambda a, b: not (a[2] < b[1] or b[2] < a[1])
    assert sorted(map(tuple, runs.overlaps(df).collect())) == [(a[0], b[0]) for a in files for b in files if a[0] < b[0] and meet(a, b)]
    assert {r["user_key"]: r["candidate_files"] for r in runs.prune(spark.createDataFrame([(k,) for k in "abcz0c"], "user_key string"), df).collect()} == {k: sum(a[1] <= k <= a[2] for a in files) for k in "abcz0"}
    leveled = df.selectExpr("file_number AS number", "CAST(file_number % 2 AS INT) AS level", "smallest", "largest")
    assert sorted(r["number"] for r in runs.trivial_moves(leveled, 0).collect()) == [a[0] for a in files if a[0] % 2 == 0 and not any(b[0] % 2 and meet(a, b) for b in files)]
    assert runs.overlaps(df.where("false")).count() == 0


def test_no_query_makes_pairs(spark):
    for name in ("l0_overlap", "file_prune", "trivial_move", "batch_append", "slice_compare", "rle_runs", "seek_ge"):
        plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
