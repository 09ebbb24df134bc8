"""One query per operator over the driver's tables. Those with SQL in oracles.py return the same rows and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions import native_bytes as N
from ..operators import compaction, oplog, reads, runs
from ..schema import FLUSH_BYTES, RESTART
from ..shared import written

AT, OPS, BATCH, LAST = 5000, 1000, 100, 6


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a changelog: a key per user, an operation per event, errors delete."""
    return oplog.changelog(table(spark, d, "events"), F.col("user_id"), F.col("event_id") + 1, F.col("event_type") == "error", F.col("props"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return runs.file_stats(log(spark, d), runs.by_ops(OPS))


def leveled(spark: SparkSession, d: str) -> DataFrame:
    """The log's files, dealt to levels 0 and 1 by parity."""
    f = files(spark, d)
    return f.select((F.col("file_number") % 2).cast("int").alias("level"), F.col("file_number").alias("number"), "smallest", "largest")


def line_files(spark: SparkSession, d: str) -> DataFrame:
    """lineitem's orders in files of 256 order keys, on levels by order: sizes 1 MiB a row."""
    n = F.floor(F.col("l_orderkey") / 256).cast("long")
    return table(spark, d, "lineitem").groupBy(n.alias("number")).agg((F.count("*") * 1048576).cast("long").alias("file_size")).select((F.col("number") % 7).cast("int").alias("level"), "number", "file_size")


def edits(spark: SparkSession, d: str) -> DataFrame:
    """orders as manifest edits: each adds or deletes a file."""
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 7).cast("int").alias("level"), F.col("o_custkey").alias("number"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("edit_id"), (F.col("o_orderstatus") != "F").cast("int").alias("is_add"))


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name")


def deeper(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT '100' AS smallest, '119' AS largest")


def _sorted_run(df: DataFrame) -> DataFrame:
    return written(df.repartitionByRange("user_key", F.desc("seq")).sortWithinPartitions("user_key", F.desc("seq")))


def write_batch(s, d):
    ops = table(s, d, "orders").select(F.col("o_orderkey").alias("op_idx"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("type"), F.col("o_custkey").cast("string").alias("user_key"))
    return oplog.batches(ops, 1, BATCH).select("batch_id", "seq", "type", "user_key")


def batch_append(s, d):
    """The log's later half as one batch, then its earlier half appended to it."""
    x = log(s, d).select("user_key", "seq", "type")
    middle = x.agg(F.floor(F.max("seq") / 2)).scalar()
    return oplog.append(x.where(F.col("seq") > middle), x.where(F.col("seq") <= middle)).select(F.col("seq").alias("new_seq"), "user_key", "type")


def wal_replay(s, d):
    x = log(s, d).select("user_key", "seq", "type")
    return oplog.replay(x, x.where("seq BETWEEN 101 AND 200"))


def multi_get(s, d):
    keys = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("user_key"))
    return reads.multi_get(log(s, d), keys)


def latest_lines(s, d):
    """lineitem as a changelog: a key for each line of an order, numbered by when it shipped; returned lines are deletes."""
    line = table(s, d, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    newest = line.groupBy(key.alias("user_key")).agg(F.count("*").alias("versions"), F.max(order).alias("v"))
    return newest.where("v.l_returnflag <> 'R'").select("user_key", "versions", F.col("v.l_shipdate").alias("shipped"), F.col("v.l_extendedprice").alias("value"))


def contains_key(s, d):
    keys = log(s, d).select(F.col("user_key").cast("long").alias("c_custkey")).distinct()
    return table(s, d, "customer").select("c_custkey").join(keys, "c_custkey", "left_semi")


def merge_runs(s, d):
    x = log(s, d).select("user_key", "seq")
    parts = [x.where(F.pmod("seq", F.lit(10)) == i) for i in range(10)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return reads.positions(out, [F.col("user_key"), F.desc("seq")]).select("pos", "user_key", "seq")


def seek_ge(s, d):
    targets = table(s, d, "supplier").select(F.concat(F.lit("Customer#0000"), F.col("s_suppkey").cast("string")).alias("target"))
    return reads.seek(names(s, d), targets, "c_name", "target")


def prefix_shared(s, d):
    p = reads.adjacent(names(s, d).select(F.col("c_name").alias("k")).distinct(), [F.col("k")], "k")
    shared = F.when((F.col("pos") - 1) % RESTART == 0, 0).otherwise(C.common_prefix(F.col("k"), F.col("prev"))).cast("long")
    return p.select("k", shared.alias("shared"), (F.length("k") - shared).cast("long").alias("non_shared"))


def restart_points(s, d):
    p = reads.positions(names(s, d).select(F.col("c_name").alias("k")).distinct(), [F.col("k")])
    return p.select("k", ((F.col("pos") - 1) % RESTART == 0).alias("is_restart"))


def rle_runs(s, d):
    """A run starts where the symbol before differs, and ends where the next one starts."""
    e = table(s, d, "events").select("event_id", "event_type")
    p = reads.adjacent(e, [F.col("event_id")], "event_type")
    starts = p.where((F.col("pos") == 1) | ~F.col("prev").eqNullSafe(F.col("event_type"))).select(F.col("pos").alias("at"), "event_id", "event_type")
    end = e.agg(F.count("*") + 1).scalar()
    return reads.adjacent(starts, [F.col("at")], "at").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("run_start"), (F.coalesce("next", end) - F.col("at")).cast("long").alias("run_len"))


def wal_layout(s, d):
    """documents' texts as records of logs that are closed at 4 MiB: where each begins, after padding, and its fragments. Each log is laid
    out by one task; a log is bounded."""
    records = table(s, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    cut = reads.running_sums(records.withColumn("sofar", F.col("size")), [F.col("doc_id")], ["sofar"])
    cut = cut.withColumn("log", F.floor(F.greatest(F.col("sofar") - 1, F.lit(0)) / FLUSH_BYTES).cast("long"))
    return cut.groupBy("log").applyInPandas(C.laid_out, "doc_id long, log long, start long, fragments long")


def checksum_verify(s, d):
    """Rows kept with their checksums, some of which have lost their last character since, read again and checked."""
    docs = table(s, d, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("kept"))
    kept = written(docs)
    damaged = F.when(F.col("doc_id") % 100 == 7, F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    again = written(kept.withColumn("text", damaged))
    return again.select("doc_id", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) == F.col("kept")).alias("ok"))


def _bloom(s, d):
    keys = names(s, d).select("c_name").distinct()
    bits, hashes = C.bloom_shape(keys.count())
    return keys, bits, hashes


def bloom_bits(s, d):
    keys, bits, hashes = _bloom(s, d)
    return keys.select(F.explode(C.bloom_probes(F.col("c_name"), bits, hashes)).alias("bitpos")).distinct()


def bloom_no_false_negative(s, d):
    """Keys whose probes are not all among the filter's bits."""
    keys, bits, hashes = _bloom(s, d)
    probes = keys.select("c_name", F.explode(C.bloom_probes(F.col("c_name"), bits, hashes)).alias("bitpos"))
    return probes.join(bloom_bits(s, d), "bitpos", "left_anti").agg(F.countDistinct("c_name").alias("misses"))


def slice_compare(s, d):
    """Names of nations and of their regions."""
    both = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), C.compare(F.col("n_name"), F.col("r_name")).alias("cmp"))


def ikey_pack(s, d):
    return log(s, d).select("seq", C.pack_trailer(F.col("seq"), F.col("type")).alias("trailer"))


def ikey_parse(s, d):
    seq, type_ = C.unpack_trailer(F.col("trailer"))
    return ikey_pack(s, d).select(seq.alias("seq"), type_.alias("type")).withColumn("valid", F.col("type").isin(0, 1))


def compact_stats(s, d):
    return compaction.compact(log(s, d), AT).agg(F.count("*").alias("num_entries"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.max("seq").alias("max_sequence"))


def tombstone_drop(s, d):
    return compaction.dead_tombstones(compaction.drop_shadowed(log(s, d), AT), AT, deeper(s)).select("user_key", "seq")


def block_partition(s, d):
    cut = runs.cut(log(s, d), [F.col("user_key"), F.desc("seq")], 16384)
    return cut.groupBy(F.col("part").alias("block_no")).agg(F.max("user_key").alias("index_key"), F.count("*").alias("num_entries"))


def flush_by_bytes(s, d):
    cut = runs.cut(log(s, d), [F.col("seq")], 65536)
    return cut.groupBy(F.col("part").alias("file_number")).agg(F.count("*").alias("num_entries"), F.sum("bytes").alias("bytes"))


def run_write_stats(s, d):
    r = _sorted_run(log(s, d))
    return r.agg(F.count("*").alias("num_entries"), F.sum(F.octet_length("user_key").cast("long")).alias("key_bytes"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")).alias("value_bytes"))


QUERIES = {
    "get_latest": lambda s, d: reads.latest(log(s, d)),
    "snapshot_get": lambda s, d: reads.latest(log(s, d), AT),
    "asof_multi": lambda s, d: reads.as_of(log(s, d), [1000, 5000, 9000]),
    "get_point": lambda s, d: reads.get(log(s, d), "42"),
    "multi_get": multi_get,
    "scan_live": lambda s, d: reads.latest(log(s, d)).select("user_key", "value"),
    "scan_anti": lambda s, d: reads.scan_anti(log(s, d)),
    "scan_ordered": lambda s, d: reads.positions(log(s, d), [F.col("user_key"), F.desc("seq")]).select("pos", "user_key", "seq", "type"),
    "scan_range": lambda s, d: reads.latest(log(s, d).where(F.col("user_key").between("10", "19"))),
    "distinct_keys": lambda s, d: log(s, d).select("user_key").distinct(),
    "contains_key": contains_key,
    "last_sequence": lambda s, d: log(s, d).agg(F.max("seq").alias("last_sequence")),
    "write_batch": write_batch,
    "batch_counts": lambda s, d: oplog.batch_summary(log(s, d), BATCH),
    "batch_append": batch_append,
    "wal_replay": wal_replay,
    "wal_fragments": lambda s, d: table(s, d, "documents").select("doc_id", C.fragments(F.octet_length("text")).alias("fragments")),
    "wal_layout": wal_layout,
    "latest_lines": latest_lines,
    "version_intervals": lambda s, d: reads.intervals(log(s, d)),
    "merge_runs": merge_runs,
    "seek_ge": seek_ge,
    "first_last": lambda s, d: names(s, d).agg(F.min("c_name").alias("first_k"), F.max("c_name").alias("last_k"), F.min_by("c_custkey", "c_name").alias("first_custkey"), F.max_by("c_custkey", "c_name").alias("last_custkey")),
    "next_key": lambda s, d: reads.neighbours(names(s, d), "c_name").select("k", "next_k"),
    "prev_key": lambda s, d: reads.neighbours(names(s, d), "c_name").select("k", "prev_k"),
    "flush_l0": files,
    "flush_by_bytes": flush_by_bytes,
    "block_partition": block_partition,
    "run_write_stats": run_write_stats,
    "run_scan": lambda s, d: _sorted_run(log(s, d)),
    "file_prune": lambda s, d: runs.prune(log(s, d).select("user_key").distinct(), files(s, d)),
    "l0_overlap": lambda s, d: runs.overlaps(files(s, d)),
    "manifest_replay": lambda s, d: runs.replay_edits(edits(s, d)),
    "recover_last_seq": lambda s, d: files(s, d).agg(F.max("max_sequence").alias("last_sequence"), (F.max("file_number") + 1).alias("next_file_number")),
    "trivial_move": lambda s, d: runs.trivial_moves(line_ranges(s, d), 0),
    "compaction_score": lambda s, d: runs.scores(line_files(s, d), 7),
    "pick_level": lambda s, d: runs.pick_level(runs.scores(line_files(s, d), 7), 7),
    "pick_inputs": lambda s, d: runs.pick_inputs(leveled(s, d), 0),
    "compact_drop": lambda s, d: compaction.compact(log(s, d), AT),
    "tombstone_drop": tombstone_drop,
    "compact_stats": compact_stats,
    "ikey_pack": ikey_pack,
    "ikey_parse": ikey_parse,
    "varint_length": lambda s, d: table(s, d, "orders").select("o_orderkey", C.varint_length(F.col("o_orderkey")).cast("long").alias("varint_len")),
    "varint_encode": lambda s, d: table(s, d, "orders").select("o_orderkey", C.varint_hex(F.col("o_orderkey")).alias("hex")),
    "fixed_encode": lambda s, d: table(s, d, "orders").select("o_orderkey", C.fixed_hex(F.col("o_orderkey"), 4).alias("hex32"), C.fixed_hex(F.col("o_orderkey"), 8).alias("hex64")),
    "prefix_shared": prefix_shared,
    "restart_points": restart_points,
    "rle_runs": rle_runs,
    "rle_size": lambda s, d: rle_runs(s, d).groupBy("symbol").agg(F.sum(C.rle_bytes(F.col("run_len"))).alias("encoded_bytes")),
    "slice_compare": slice_compare,
    "slice_at": lambda s, d: names(s, d).select("c_custkey", C.char_at(F.col("c_name"), (F.col("c_custkey") % 20).cast("int")).alias("char_at"), C.to_text(F.col("c_name").cast("binary")).alias("as_text")),
    "slice_prefix": lambda s, d: names(s, d).select("c_custkey", C.remove_prefix(F.col("c_name"), "Customer#").alias("rest")),
    "checksum_verify": checksum_verify,
    "crc32c": lambda s, d: names(s, d).select("c_custkey", N.crc32c_of(F.col("c_name").cast("binary")).alias("crc")),
    "filter_hash": lambda s, d: names(s, d).select("c_custkey", C.filter_hash(F.col("c_name")).alias("hash")),
    "rle_values": lambda s, d: table(s, d, "events").select("event_id", (N.rle_uncompress(N.rle_compress(F.col("props").cast("binary"))) == F.col("props").cast("binary")).alias("same"), F.octet_length(N.rle_compress(F.repeat("event_type", 1 + F.col("event_id").cast("int") % 3).cast("binary"))).cast("long").alias("size")),
    "bloom_bits": bloom_bits,
    "bloom_no_false_negative": bloom_no_false_negative,
    "shard_counts": lambda s, d: names(s, d).groupBy(C.shard_of(F.col("c_name")).alias("shard")).agg(F.count("*").alias("n")),
    "cli_fill_shape": lambda s, d: s.range(10_000).select(F.format_string("key_%010d", "id").alias("k"), F.length(F.randstr(F.lit(512), F.lit(0))).cast("long").alias("value_len")),
}


def line_ranges(s: SparkSession, d: str) -> DataFrame:
    """lineitem's files with key ranges: 64 orders each, every third on level 1."""
    n = F.floor(F.col("l_orderkey") / 64).cast("long")
    key = F.lpad(F.col("l_orderkey").cast("string"), 9, "0")
    f = table(s, d, "lineitem").groupBy(n.alias("number")).agg(F.min(key).alias("smallest"), F.max(key).alias("largest"))
    return f.select(F.when(F.col("number") % 3 == 0, 1).otherwise(0).alias("level"), "number", "smallest", F.when(F.col("number") % 5 == 0, F.lpad(((F.col("number") + 2) * 64).cast("string"), 9, "0")).otherwise(F.col("largest")).alias("largest"))
