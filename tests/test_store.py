import glob
import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronolake import cli
from chronolake.operators import compaction, reads, runs
from chronolake.schema import OPLOG, Conflict, Corruption, InvalidArgument, NotFound
from chronolake.sources import wal
from chronolake.sources.store import Options, Store, WriteBatch
from chronolake.streaming.ingest import ingest, latest_view


def test_put_get_delete_and_recovery(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db")) as s:
        s.put("k1", "v1")
        assert s.get("k1") == "v1"
        s.write(WriteBatch().put("a", "1").put("b", "2").delete("a"))
        assert s.get("a") is None and s.get("b") == "2"
        s.put("empty", "")
    again = Store.open(spark, str(tmp_path / "db"))
    assert again.get("k1") == "v1" and again.get("empty") == "" and again.last == 5
    with pytest.raises(NotFound):
        again.require("a")
    with pytest.raises(InvalidArgument):
        again.get(None)
    seen = []
    again.for_each(lambda k, v: seen.append((k, v)))
    assert seen == [("b", "2"), ("empty", ""), ("k1", "v1")]


def test_snapshots_outlive_updates_compaction_and_deletes(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    ops = spark.range(2000).select(F.col("id").alias("op_idx"), F.format_string("key_%06d", "id").alias("user_key"), F.lit(1).alias("type"), F.format_string("val_%06d_payload", "id").alias("value"))
    s.write_ops(ops)
    snap = s.snapshot()
    changed = spark.range(100).select(F.col("id").alias("op_idx"), F.format_string("key_%06d", F.col("id") * 3).alias("user_key"), (F.col("id") % 2).cast("int").alias("type"), F.when(F.col("id") % 2 == 1, "new_value").alias("value"))
    s.write_ops(changed)
    for _ in range(2):
        assert s.get("key_000003", snap) == "val_000003_payload" and s.get("key_000003") == "new_value"
        assert s.get("key_000006", snap) == "val_000006_payload" and s.get("key_000006") is None
        assert s.scan(snap).count() == 2000 and s.scan().count() == 1950
        s.compact(force=True)
    s.release(snap)
    assert s.vacuum(0) and s.scan().count() == 1950
    assert s.stats().count() == len(s.live)
    gone = spark.range(500, 1500).select((F.col("id") - 500).alias("op_idx"), F.format_string("key_%06d", "id").alias("user_key"), F.lit(0).alias("type"), F.lit(None).cast("string").alias("value"))
    s.write_ops(gone)
    assert s.scan(low="key_000500", high="key_001499").count() == 0


def test_two_writers(spark, tmp_path):
    a, b = (Store.open(spark, str(tmp_path / "db")) for _ in range(2))
    a.put("x", "1")
    a.flush()
    b.put("x", "2")
    with pytest.raises(Conflict):
        b.flush()
    again = Store.open(spark, str(tmp_path / "db"))
    assert again.get("x") == "1" and len(glob.glob(f"{tmp_path}/db/runs/*")) == 1  # the loser's run is gone


def test_damage_is_reported(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db"), Options(compression="none", bloom=False)) as s:
        s.put("integrity_test", "ok" * 500)
    [run] = glob.glob(f"{tmp_path}/db/runs/*/part-*.parquet")
    data = bytearray(open(run, "rb").read())
    data[data.find(b"okok") + 100] ^= 1
    open(run, "wb").write(data)
    for crc in glob.glob(f"{tmp_path}/db/runs/*/.*.crc"):
        import os

        os.remove(crc)
    with pytest.raises(Corruption):
        Store.open(spark, str(tmp_path / "db")).get("integrity_test")
    [edit] = glob.glob(f"{tmp_path}/db/manifest/*.json")
    open(edit, "a").write("x")
    with pytest.raises(Corruption):
        Store.open(spark, str(tmp_path / "db"))


def test_a_crash_at_any_point_leaves_a_whole_store(spark, tmp_path):
    path = str(tmp_path / "db")
    a = Store.open(spark, path)
    a.put("flushed", "1")
    a.flush()
    a.write(WriteBatch().put("logged", "2").put("gone", "3").delete("gone"))
    a.put("torn", "x" * 70_000)  # over three blocks of the log
    [log] = glob.glob(f"{path}/wal/*.log")
    whole = open(log, "rb").read()
    for cut in (len(whole), len(whole) - 1, len(whole) - 40_000, 60, 3, 0):  # a crash may cut the log anywhere: whole batches count
        open(log, "wb").write(whole[:cut])
        b = Store.open(spark, path)
        assert b.get("flushed") == "1" and b.get("logged") == ("2" if cut > 60 or cut == 60 and b.get("logged") else None) and b.get("gone") is None
        assert (b.get("torn") is not None) == (cut == len(whole)) and b.last == (5 if cut == len(whole) else 4 if b.get("logged") else 1)
    open(log, "wb").write(whole[:20] + bytes([whole[20] ^ 1]) + whole[21:])
    with pytest.raises(Corruption):  # damage that whole records follow is no torn end
        Store.open(spark, path)
    open(log, "wb").write(whole)
    (tmp_path / "db/manifest/.tmp-half-000000000002.json").write_text('{"edit": {"add')  # a commit that was cut off
    c = Store.open(spark, path)
    c.flush()
    assert c.get("logged") == "2" and c.last == 5 and not glob.glob(f"{path}/wal/*.log")
    spark.createDataFrame([("orphan", 9, 1, "")], OPLOG).write.parquet(f"{path}/runs/000099-dead")  # a writer that never committed
    assert c.vacuum() == [] and set(c.vacuum(0)) == {"runs/000099-dead", "manifest/.tmp-half-000000000002.json"}
    assert Store.open(spark, path).get("torn") == "x" * 70_000


def test_log_records_lie_over_blocks(tmp_path):
    import os

    parts = [b"tiny", bytes(65 + i % 26 for i in range(70_000)), b"after_big", b"", b"x" * (32768 - 7), b"y" * 20, b"z" * 32_730, os.urandom(200_000)]
    data = b""
    for p in parts:
        data += wal.fragments(p, len(data))
    assert wal.records(data) == (parts, len(data))
    for cut in range(0, len(data), 4999):
        got = wal.records(data[:cut])[0]
        assert got == parts[: len(got)] and (cut == 0 or len(got) < len(parts))
    ops = [(1, b"k", b""), (0, b"", None), (1, bytes(range(256)), b"v" * 300)]
    assert wal.decode(wal.encode(7, ops)) == (7, ops)


def test_snapshots_bind_other_handles(spark, tmp_path):
    path = str(tmp_path / "db")
    a = Store.open(spark, path, Options(auto_compact=False))
    a.put("k", "old")
    a.flush()
    snap = a.snapshot()
    reader = Store.open(spark, path)
    b = Store.open(spark, path)
    for v in ("new", "newer"):
        b.put("k", v)
        b.flush()
    b.compact(force=True)
    assert b.vacuum(0) == [] or all(not n.startswith("runs") for n in b.vacuum(0)) or reader.get("k") == "old"
    assert a.get("k", snap) == "old" and reader.get("k") == "old"  # neither has seen the new edits; their runs are there
    a.refresh()
    assert a.get("k", snap) == "old" and a.get("k") == "newer"
    a.release(snap)
    assert any(n.startswith("runs") for n in b.vacuum(0)) and a.get("k") == "newer"


def test_compaction_follows_flushes_and_cuts_files(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"), Options(target_bytes=20_000))
    for i in range(4):
        s.write_ops(spark.range(500).select(F.col("id").alias("op_idx"), F.format_string("k%04d", (F.col("id") * 7 + i) % 1000).alias("user_key"), F.lit(1).alias("type"), F.md5(F.concat("id", F.lit(i))).alias("value")))
    files = s.stats().collect()
    assert {f["level"] for f in files} == {1} and len(files) > 1
    files.sort(key=lambda f: f["smallest"])
    assert all(x["largest"] <= y["smallest"] for x, y in zip(files, files[1:])) and s.scan().count() == len({(i * 7 + j) % 1000 for i in range(500) for j in range(4)})
    assert s.get("k0007") is not None and sum(f["num_entries"] for f in files) == s.scan().count()


def test_bytes_of_any_sort(spark, tmp_path):
    path, keys = str(tmp_path / "db"), [b"", b"\x00", b"\xff\xfe", b"a\x00b", bytes(range(256))]
    with Store.open(spark, path, Options(binary=True)) as s:
        for i, k in enumerate(keys):
            s.put(k, k[::-1] * (i + 1))
        s.delete(b"a\x00b")
        assert s.get(b"\xff\xfe") == b"\xfe\xff" * 3
        with pytest.raises(InvalidArgument):
            s.put("text", "text")
    again, seen = Store.open(spark, path, Options(binary=True)), []
    assert [again.get(k) for k in keys] == [k[::-1] * (i + 1) if i != 3 else None for i, k in enumerate(keys)]
    again.for_each(lambda k, v: seen.append(k))
    assert seen == sorted(k for k in keys if k != b"a\x00b")
    again.compact(force=True)
    assert again.get(b"\x00") == b"\x00\x00" and again.scan(low=b"\x01").count() == 1
    with pytest.raises(InvalidArgument):
        Store.open(spark, path)


def test_bulk_writes_are_checked_before_they_count(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    schema = "op_idx long, user_key string, type int, value string"
    for rows in ([(0, None, 1, "v")], [(0, "k", 1, None)], [(0, "k", 2, "v")], [(1, "k", 1, "v")], [(0, "k", 1, "v"), (0, "l", 1, "v")], [(0, "k", 1, "v"), (0, "l", 1, "v"), (2, "m", 1, "v")], [(0, "k", 1, "v"), (2, "l", 1, "v")]):
        with pytest.raises(InvalidArgument):
            s.write_ops(spark.createDataFrame(rows, schema))
    assert s.last == 0 and not s.live and not glob.glob(f"{tmp_path}/db/runs/*")
    assert s.write_ops(spark.createDataFrame([(1, "k", 0, None), (0, "k", 1, "v")], schema)) == 2 and s.get("k") is None
    assert s.write_ops(spark.createDataFrame([], schema)) == 2


def test_batches_iterate_append_and_clear():
    a, b, seen = WriteBatch().put("a", "1").delete("a"), WriteBatch().put("b", ""), []
    a.append(b).iterate(lambda k, v: seen.append((k, v)), seen.append)
    assert seen == [("a", "1"), "a", ("b", "")] and len(a) == 3
    a.clear()
    assert len(a) == 0
    with pytest.raises(InvalidArgument):
        a.put("a", None)


def test_cache_and_charge(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    s.put("a", "1")
    s.flush()
    before = s.charge()
    s.cache()
    assert s.scan().count() == 1 and s.charge() > before
    s.put("a", "2")
    assert s.get("a") == "2" and [r["value"] for r in s.scan().collect()] == ["2"]
    s.flush()
    assert [r["value"] for r in s.scan().collect()] == ["2"]
    s.close()
    assert s.charge() == before


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "db")
    run = lambda *a: (cli.main([path, *a]), capsys.readouterr().out)
    assert cli.main([]) == 2 and "put" in capsys.readouterr().out
    assert run("put", "city", "Paris")[0] == 0 and run("get", "city") == (0, "Paris\n")
    assert run("del", "city")[0] == 0 and run("get", "city") == (1, "NOT_FOUND\n")
    assert "50 writes" in run("fill", "50", "8")[1]
    lines = run("scan")[1].splitlines()
    assert len(lines) == 50 and lines[0].startswith("fill_0000000000\t") and len(lines[0]) == 16 + 8
    out = run("bench", "40", "16")[1]
    assert "40 writes" in out and "40 found" in out


def test_one_hot_key_and_positions_of_large_tables(spark):
    """More rows than a range sampler looks at, a third of them of one key, all columns read."""
    log = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9000)).alias("user_key"), (F.col("id") + 1).alias("seq"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("type"), F.md5(F.col("id").cast("string")).alias("value")).repartition(7)
    order = [F.col("user_key"), F.desc("seq")]
    rows = sorted(((r["user_key"], -r["seq"], r["value"]) for r in log.collect()))
    got = reads.positions(log, order).select("pos", "user_key", "seq", "value").orderBy("pos").collect()
    assert [(r["pos"], r["user_key"], -r["seq"], r["value"]) for r in got] == [(i + 1, *r) for i, r in enumerate(rows)]
    sizes = [len(k) + len(v) * bool((-s - 1) % 5) + 8 for k, s, v in rows]
    sofar = runs.running(log.withColumn("value", F.when(F.col("type") == 1, F.col("value"))), order).orderBy("sofar").select("sofar").collect()
    assert [r["sofar"] for r in sofar] == list(itertools.accumulate(sizes))
    spans = reads.intervals(log).where("user_key = 'hot'").orderBy("valid_from").collect()
    assert [r["valid_to"] for r in spans] == [*[r["valid_from"] for r in spans[1:]], None]


def test_reads_agree_with_a_model(spark):
    rng = random.Random(5)
    ops = [(f"k{rng.randrange(12)}", i + 1, t := int(rng.random() < 0.7), f"v{i}" if t else None) for i in range(300)]
    log = spark.createDataFrame(ops, "user_key string, seq long, type int, value string")
    for at in (0, 1, 50, 299, 300):
        model = {}
        for k, s, t, v in ops:
            if s <= at:
                model[k] = v if t else None
        want = {k: v for k, v in model.items() if v is not None}
        assert {r["user_key"]: r["value"] for r in reads.latest(log, at).collect()} == want
        if at >= 50:
            assert {r["user_key"]: r["value"] for r in reads.latest(compaction.compact(log, 50), at).collect()} == want


def test_positions_and_seek_with_ties_and_empties(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "d", "b"]], "k string")
    assert [(r["pos"], r["k"]) for r in reads.positions(df.distinct(), [F.col("k")]).orderBy("pos").collect()] == [(1, "a"), (2, "b"), (3, "d")]
    got = reads.seek(df, spark.createDataFrame([("",), ("c",), ("d",), ("e",)], "t string"), "k", "t")
    assert {r["target"]: r["found"] for r in got.collect()} == {"": "a", "c": "d", "d": "d", "e": None}
    assert reads.positions(df.where("false"), [F.col("k")]).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, "a", 1, "1"), (1, "b", 1, "2"), (2, "a", 0, None)], "op_order long, user_key string, type int, value string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    store = Store.open(spark, str(tmp_path / "db"))
    for _ in range(2):  # started again, nothing is written twice
        q = ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
    assert store.get("a") is None and store.get("b") == "2" and store.last == 3
    other = str(tmp_path / "other")  # a stream of its own, whose batches have the same numbers
    spark.range(200_000).select(F.col("id").alias("op_order"), (F.col("id") % 50_000).cast("string").alias("user_key"), F.lit(1).alias("type"), F.col("id").cast("string").alias("value")).repartition(5).write.parquet(other)
    q = ingest(spark.readStream.schema(spark.read.parquet(other).schema).parquet(other), store, str(tmp_path / "ckpt2"))
    q.processAllAvailable()
    q.stop()
    assert store.last == 200_003 and store.get("b") == "2" and store.log().count() == 200_003
    assert store.scan().where("user_key <> 'b' AND value <> user_key + 150000").count() == 0 and store.scan().count() == 50_001
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", 2, 1, "new"), ("a", 1, 1, "old")], "user_key string, seq long, type int, value string").write.parquet(log)
    q = latest_view(spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)).writeStream.outputMode("complete").format("memory").queryName("latest_view_test").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("latest_view_test").collect()] == [("a", 2, 1, "new")]
