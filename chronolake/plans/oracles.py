"""DuckDB SQL of the registered queries."""

_LOG = """oplog AS (SELECT CAST(user_id AS VARCHAR) AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS type,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"""
_NEWEST = "r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM oplog)"
_FILES = """f AS (SELECT CAST(floor((seq - 1) / 1000) AS BIGINT) AS file_number, count(*) AS num_entries, min(user_key) AS smallest, max(user_key) AS largest,
  max(seq) AS max_sequence FROM oplog GROUP BY 1)"""
_LAG = "l AS (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM oplog)"
_KEPT = "k AS (SELECT user_key, seq, type, value FROM l WHERE newer IS NULL OR newer > 5000)"
_SIZE = "strlen(user_key) + coalesce(strlen(value), 0) + 8"
_NAMES = "n AS (SELECT DISTINCT c_name AS k FROM customer)"
_POS = "p AS (SELECT k, row_number() OVER (ORDER BY k) AS rn, lag(k) OVER (ORDER BY k) AS prev FROM n)"
_RUNS = """e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events),
  q AS (SELECT event_type AS symbol, min(event_id) AS run_start, count(*) AS run_len FROM e GROUP BY event_type, g)"""
_LEVELS = "v AS (SELECT CAST(file_number % 2 AS INT) AS level, file_number AS number, smallest, largest FROM f)"
_LINES = """g AS (SELECT CAST(number % 7 AS INT) AS level, count(*) AS n, sum(size) AS bytes FROM
  (SELECT l_orderkey // 256 AS number, count(*) * 1048576 AS size FROM lineitem GROUP BY 1) GROUP BY 1),
  s AS (SELECT CAST(i AS INT) AS level, CAST(CASE WHEN i = 0 THEN coalesce(n, 0) / 4.0 ELSE coalesce(bytes, 0) / (10485760.0 * pow(10.0, i - 1)) END AS DOUBLE) AS score
  FROM range(7) t(i) LEFT JOIN g ON g.level = i)"""


def _little(start: str, size: int) -> str:
    """The number of some bytes, lowest first, of the key's hex."""
    return "CAST('0x' || " + " || ".join(f"substr(x, 2 * ({start} + {i}) + 1, 2)" for i in reversed(range(size))) + " AS UBIGINT)"


_WORDS = "z AS (SELECT k, strlen(k) AS n, hex(k) AS x FROM (SELECT DISTINCT c_name AS k FROM customer))"
_HASH = (_WORDS, f"a AS (SELECT *, list_reduce(list_prepend(xor(3164544308::UBIGINT, n::UBIGINT * 3332679571 % 4294967296), list_transform(range(0, n // 4), lambda i: {_little('4 * i', 4)})), lambda h, w: xor((h + w) % 4294967296 * 3332679571 % 4294967296, ((h + w) % 4294967296 * 3332679571 % 4294967296) >> 16)) AS h0 FROM z)",
         f"""t AS (SELECT *, CASE n % 4 WHEN 3 THEN {_little('n - 3', 3)} WHEN 2 THEN {_little('n - 2', 2)} WHEN 1 THEN {_little('n - 1', 1)} ELSE 0 END AS rest FROM a)""",
         "u AS (SELECT *, (h0 + rest) % 4294967296 * 3332679571 % 4294967296 AS v FROM t)", "g AS (SELECT k, CASE WHEN n % 4 = 0 THEN h0 ELSE xor(v, v >> 24) END AS h FROM u)")
_FILTER = (*_HASH, "s AS (SELECT (greatest(64, count(*) * 10) + 7) // 8 * 8 AS bits FROM g)", "p AS (SELECT k, CAST((h + i::UBIGINT * ((h >> 17) | (h << 15) % 4294967296)) % 4294967296 % bits AS BIGINT) AS bit FROM g, s, range(6) q(i))")


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _byte(i: int) -> str:
    return f"lpad(printf('%X', (o_orderkey >> {8 * i}) & 255), 2, '0')"


def _septet(i: int) -> str:
    more = f"CASE WHEN o_orderkey >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END"
    there = f"o_orderkey >= {1 << 7 * i}" if i else "true"
    return f"CASE WHEN {there} THEN lpad(printf('%X', ((o_orderkey >> {7 * i}) & 127) + {more}), 2, '0') ELSE '' END"


ORACLES = {
    "get_latest": _with(_LOG, _NEWEST) + "SELECT user_key, seq, value FROM r WHERE rn = 1 AND type = 1",
    "snapshot_get": _with(_LOG, "r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM oplog WHERE seq <= 5000)") + "SELECT user_key, seq, value FROM r WHERE rn = 1 AND type = 1",
    "asof_multi": _with(_LOG, "t(s) AS (VALUES (CAST(1000 AS BIGINT)), (5000), (9000))", "r AS (SELECT *, row_number() OVER (PARTITION BY user_key, s ORDER BY seq DESC) AS rn FROM oplog JOIN t ON seq <= s)") + "SELECT user_key, s, seq, value FROM r WHERE rn = 1 AND type = 1",
    "get_point": _with(_LOG, _NEWEST) + "SELECT user_key, seq, value FROM r WHERE rn = 1 AND type = 1 AND user_key = '42'",
    "multi_get": _with(_LOG, _NEWEST) + "SELECT CAST(s_suppkey AS VARCHAR) AS user_key, r.seq IS NOT NULL AS found, r.value FROM supplier LEFT JOIN r ON r.user_key = CAST(s_suppkey AS VARCHAR) AND rn = 1 AND type = 1",
    "scan_live": _with(_LOG, _NEWEST) + "SELECT user_key, value FROM r WHERE rn = 1 AND type = 1",
    "scan_anti": _with(_LOG, _NEWEST) + "SELECT user_key, seq FROM r WHERE rn = 1 AND type = 1",
    "scan_ordered": _with(_LOG) + "SELECT row_number() OVER (ORDER BY user_key, seq DESC) AS pos, user_key, seq, type FROM oplog",
    "scan_range": _with(_LOG, _NEWEST) + "SELECT user_key, seq, value FROM r WHERE rn = 1 AND type = 1 AND user_key BETWEEN '10' AND '19'",
    "distinct_keys": _with(_LOG) + "SELECT DISTINCT user_key FROM oplog",
    "contains_key": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)",
    "last_sequence": _with(_LOG) + "SELECT max(seq) AS last_sequence FROM oplog",
    "write_batch": "SELECT o_orderkey // 100 AS batch_id, 1 + o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS type, CAST(o_custkey AS VARCHAR) AS user_key FROM orders",
    "batch_counts": _with(_LOG) + "SELECT (seq - 1) // 100 AS batch_id, min(seq) AS sequence, count(*) AS cnt, CAST(sum(type) AS BIGINT) AS puts, CAST(sum(1 - type) AS BIGINT) AS deletes FROM oplog GROUP BY 1",
    "batch_append": _with(_LOG, "h AS (SELECT max(seq) // 2 AS m FROM oplog)", "e AS (SELECT min(seq) AS least FROM oplog, h WHERE seq <= m)", "t AS (SELECT max(seq) AS last FROM oplog, h WHERE seq > m)") + "SELECT CASE WHEN seq > m THEN seq ELSE seq - least + last + 1 END AS new_seq, user_key, type FROM oplog, h, e, t",
    "wal_replay": _with(_LOG) + "SELECT user_key, seq, type FROM oplog",
    "wal_fragments": "SELECT doc_id, CAST(greatest(ceil(strlen(text) / 32761.0), 1) AS BIGINT) AS fragments FROM documents",
    "version_intervals": _with(_LOG) + "SELECT user_key, seq AS valid_from, lead(seq) OVER (PARTITION BY user_key ORDER BY seq) AS valid_to, type FROM oplog",
    "merge_runs": _with(_LOG) + "SELECT row_number() OVER (ORDER BY user_key, seq DESC) AS pos, user_key, seq FROM oplog",
    "seek_ge": _with(_NAMES, "t AS (SELECT DISTINCT 'Customer#0000' || CAST(s_suppkey AS VARCHAR) AS target FROM supplier)") + "SELECT target, min(k) AS found FROM t LEFT JOIN n ON k >= target GROUP BY target",
    "first_last": "SELECT min(c_name) AS first_k, max(c_name) AS last_k, min_by(c_custkey, c_name) AS first_custkey, max_by(c_custkey, c_name) AS last_custkey FROM customer",
    "next_key": _with(_NAMES) + "SELECT k, lead(k) OVER (ORDER BY k) AS next_k FROM n",
    "prev_key": _with(_NAMES) + "SELECT k, lag(k) OVER (ORDER BY k) AS prev_k FROM n",
    "flush_l0": _with(_LOG, _FILES) + "SELECT * FROM f",
    "flush_by_bytes": _with(_LOG, f"b AS (SELECT {_SIZE} AS b, sum({_SIZE}) OVER (ORDER BY seq) AS t FROM oplog)") + "SELECT CAST((t - 1) // 65536 AS BIGINT) AS file_number, count(*) AS num_entries, CAST(sum(b) AS BIGINT) AS bytes FROM b GROUP BY 1",
    "block_partition": _with(_LOG, f"b AS (SELECT user_key, sum({_SIZE}) OVER (ORDER BY user_key, seq DESC) AS t FROM oplog)") + "SELECT CAST((t - 1) // 16384 AS BIGINT) AS block_no, max(user_key) AS index_key, count(*) AS num_entries FROM b GROUP BY 1",
    "run_write_stats": _with(_LOG) + "SELECT count(*) AS num_entries, CAST(sum(strlen(user_key)) AS BIGINT) AS key_bytes, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS value_bytes FROM oplog",
    "run_scan": _with(_LOG) + "SELECT user_key, seq, type, value FROM oplog",
    "file_prune": _with(_LOG, _FILES, "u AS (SELECT DISTINCT user_key FROM oplog)") + "SELECT user_key, count(file_number) AS candidate_files FROM u LEFT JOIN f ON user_key BETWEEN smallest AND largest GROUP BY 1",
    "l0_overlap": _with(_LOG, _FILES) + "SELECT a.file_number AS a_file, b.file_number AS b_file FROM f a JOIN f b ON a.file_number < b.file_number AND NOT (a.largest < b.smallest OR b.largest < a.smallest)",
    "manifest_replay": "WITH e AS (SELECT CAST(o_orderkey % 7 AS INT) AS level, o_custkey AS number, o_orderkey // 2 AS edit_id, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS is_add FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC, is_add DESC) AS rn FROM e) SELECT level, number, edit_id FROM r WHERE rn = 1 AND is_add = 1",
    "recover_last_seq": _with(_LOG, _FILES) + "SELECT max(max_sequence) AS last_sequence, max(file_number) + 1 AS next_file_number FROM f",
    "trivial_move": """WITH x AS (SELECT l_orderkey // 64 AS number, min(lpad(CAST(l_orderkey AS VARCHAR), 9, '0')) AS smallest, max(lpad(CAST(l_orderkey AS VARCHAR), 9, '0')) AS largest FROM lineitem GROUP BY 1),
      f AS (SELECT CASE WHEN number % 3 = 0 THEN 1 ELSE 0 END AS level, number, smallest, CASE WHEN number % 5 = 0 THEN lpad(CAST((number + 2) * 64 AS VARCHAR), 9, '0') ELSE largest END AS largest FROM x)
      SELECT number, level AS old_level, level + 1 AS new_level FROM f a WHERE level = 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.level = 1 AND NOT (a.largest < b.smallest OR b.largest < a.smallest))""",
    "compaction_score": _with(_LINES) + "SELECT level, score FROM s",
    "pick_level": _with(_LINES) + "SELECT level FROM s WHERE score >= 1 AND level < 6 ORDER BY score DESC, level LIMIT 1",
    "pick_inputs": _with(_LOG, _FILES, _LEVELS, "z AS (SELECT * FROM v WHERE level = 0 ORDER BY number LIMIT 1)", "c AS (SELECT v.* FROM v, z WHERE v.level = 0 AND NOT (v.largest < z.smallest OR z.largest < v.smallest))", "h AS (SELECT min(smallest) AS s, max(largest) AS l FROM c)") + "SELECT 'input' AS which, level, number FROM c UNION ALL SELECT 'next', v.level, v.number FROM v, h WHERE v.level = 1 AND NOT (v.largest < h.s OR h.l < v.smallest)",
    "compact_drop": _with(_LOG, _LAG, _KEPT) + "SELECT * FROM k WHERE NOT (type = 0 AND seq <= 5000)",
    "tombstone_drop": _with(_LOG, _LAG, _KEPT) + "SELECT user_key, seq FROM k WHERE type = 0 AND seq <= 5000 AND NOT (user_key BETWEEN '100' AND '119')",
    "compact_stats": _with(_LOG, _LAG, _KEPT) + "SELECT count(*) AS num_entries, min(user_key) AS smallest, max(user_key) AS largest, max(seq) AS max_sequence FROM k WHERE NOT (type = 0 AND seq <= 5000)",
    "ikey_pack": _with(_LOG) + "SELECT seq, seq * 256 + type AS trailer FROM oplog",
    "ikey_parse": _with(_LOG) + "SELECT seq, CAST(type AS BIGINT) AS type, true AS valid FROM oplog",
    "varint_length": "SELECT o_orderkey, CAST(1 + " + " + ".join(f"(o_orderkey >= {1 << 7 * i})::INT" for i in range(1, 9)) + " AS BIGINT) AS varint_len FROM orders",
    "varint_encode": "SELECT o_orderkey, " + " || ".join(_septet(i) for i in range(5)) + " AS hex FROM orders",
    "fixed_encode": "SELECT o_orderkey, " + " || ".join(_byte(i) for i in range(4)) + " AS hex32, " + " || ".join(_byte(i) for i in range(8)) + " AS hex64 FROM orders",
    "prefix_shared": _with(_NAMES, _POS, "c AS (SELECT k, CASE WHEN (rn - 1) % 16 = 0 THEN 0 ELSE len(list_filter(range(1, least(len(k), len(prev)) + 1), lambda i: k[1:i] = prev[1:i])) END AS shared FROM p)") + "SELECT k, CAST(shared AS BIGINT) AS shared, CAST(len(k) - shared AS BIGINT) AS non_shared FROM c",
    "restart_points": _with(_NAMES, _POS) + "SELECT k, (rn - 1) % 16 = 0 AS is_restart FROM p",
    "rle_runs": _with(_RUNS) + "SELECT * FROM q",
    "rle_size": _with(_RUNS) + "SELECT symbol, CAST(sum(run_len // 255 * 3 + CASE WHEN run_len % 255 >= 4 THEN 3 ELSE run_len % 255 END) AS BIGINT) AS encoded_bytes FROM q GROUP BY 1",
    "slice_compare": "SELECT n_name AS a, r_name AS b, CASE WHEN n_name < r_name THEN -1 WHEN n_name > r_name THEN 1 ELSE 0 END AS cmp FROM nation JOIN region ON n_regionkey = r_regionkey",
    "slice_prefix": "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS rest FROM customer",
    "checksum_verify": "SELECT doc_id, NOT (doc_id % 100 = 7 AND length(coalesce(text, '')) > 0) AS ok FROM documents",
    "bloom_no_false_negative": _with(*_FILTER, "b AS (SELECT DISTINCT bit FROM p)") + "SELECT count(DISTINCT k) AS misses FROM p WHERE bit NOT IN (SELECT bit FROM b)",
    "bloom_bits": _with(*_FILTER) + "SELECT DISTINCT bit AS bitpos FROM p",
    "filter_hash": _with(*_HASH) + "SELECT c_custkey, CAST(h AS BIGINT) AS hash FROM customer JOIN g ON k = c_name",
    "crc32c": "SELECT c_custkey, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(c_name) + 1), lambda i: ord(c_name[i])::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda r, z: xor(r >> 1, 2197175160 * (r & 1)))), 4294967295::UBIGINT) AS BIGINT) AS crc FROM customer",
    "rle_values": "SELECT event_id, true AS same, CAST(strlen(event_type) * (1 + event_id % 3) AS BIGINT) AS size FROM events",
    "shard_counts": "SELECT CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 16 AS shard, count(*) AS n FROM customer GROUP BY 1",
    "slice_at": "SELECT c_custkey, CASE WHEN c_custkey % 20 < length(c_name) THEN substr(c_name, c_custkey % 20 + 1, 1) END AS char_at, c_name AS as_text FROM customer",
    "wal_layout": """WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0) AS size, greatest(sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id) - 1, 0)::BIGINT // 4194304 AS log FROM documents),
      r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY log ORDER BY doc_id) AS rn FROM d),
      w AS (SELECT r.*, 0::BIGINT AS start, 1 + greatest(0, (size - 32761 + 32760) // 32761) AS fragments FROM r WHERE rn = 1
        UNION ALL SELECT doc_id, size, log, rn, start, 1 + greatest(0, (size - (32768 - start % 32768 - 7) + 32760) // 32761) AS fragments
        FROM (SELECT r.*, e + CASE WHEN 32768 - e % 32768 < 7 THEN 32768 - e % 32768 ELSE 0 END AS start FROM r JOIN (SELECT log, rn, start + size + 7 * fragments AS e FROM w) p ON r.log = p.log AND r.rn = p.rn + 1))
      SELECT doc_id, log, start, CAST(fragments AS BIGINT) AS fragments FROM w""",
    "latest_lines": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn,
        count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS versions FROM lineitem)
      SELECT l_orderkey || '-' || l_linenumber AS user_key, versions, l_shipdate AS shipped, l_extendedprice AS value FROM r WHERE rn = 1 AND l_returnflag <> 'R'""",
    "cli_fill_shape": "SELECT printf('key_%010d', i) AS k, CAST(512 AS BIGINT) AS value_len FROM range(10000) t(i)",
}
