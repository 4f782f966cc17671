"""The registered queries in plain SQL, written straight from their definitions over the same tables.

Both sides shift measured values by 1e-9 before rounding them to six places: means of short decimals often end exactly
on a 5, where the order of a floating-point sum would decide the last digit.
"""

from __future__ import annotations

from ballast.fixed_values import (
    DEVICE_NAME_PREFIX,
    MSG_BAD_FORMAT,
    MSG_BAD_SUFFIX,
    MSG_EXCLUSIVE,
    MSG_FOUND,
    MSG_NO_RANK,
    MSG_NO_SOURCE,
    MSG_NOT_DISCOVERED,
    MSG_NOT_FOUND,
    MSG_NUM_SHARDS,
    MSG_READY,
    QUANTITY_FORMAT,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- relations ------------------------------------------------------------------------------------------------------

TENSORS = """
tensors AS (
  SELECT 'wb-' || l_suppkey AS buffer_id, l_suppkey,
         'layer.' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS name,
         CASE l_returnflag WHEN 'A' THEN 'F16' WHEN 'R' THEN 'F32' ELSE 'BF16' END AS dtype,
         CAST(l_quantity AS BIGINT) AS d0, 1 + l_partkey % 8 AS d1,
         CAST(l_quantity AS BIGINT) * (1 + l_partkey % 8) AS numel,
         CAST(l_quantity AS BIGINT) * (1 + l_partkey % 8) * (CASE WHEN l_returnflag = 'R' THEN 4 ELSE 2 END) AS nbytes,
         l_orderkey, l_linenumber, l_partkey, l_quantity
  FROM lineitem)"""

PACKED = (
    TENSORS
    + """,
packed AS (
  SELECT *,
    CAST(sum(nbytes) OVER (PARTITION BY buffer_id
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, nbytes, dtype
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - nbytes AS byte_offset,
    row_number() OVER (PARTITION BY buffer_id
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, nbytes, dtype) - 1 AS position
  FROM tensors)"""
)

TOTALS = """
totals AS (
  SELECT buffer_id, CAST(sum(nbytes) AS BIGINT) AS total_bytes, CAST(1 + any_value(l_suppkey) % 8 AS INTEGER) AS num_shards
  FROM tensors GROUP BY buffer_id)"""

SHARDS = (
    TOTALS
    + """,
shards AS (
  SELECT buffer_id, total_bytes, num_shards, CAST(i AS INTEGER) AS shard_index,
         i * (total_bytes // num_shards) + least(i, total_bytes % num_shards) AS offset_bytes,
         total_bytes // num_shards + (CASE WHEN i < total_bytes % num_shards THEN 1 ELSE 0 END) AS size_bytes
  FROM (SELECT *, unnest(range(0, num_shards)) AS i FROM totals))"""
)

DOCS = """
docs AS (
  SELECT 'doc-' || lang AS buffer_id, doc_id AS ordinal, encode(text) AS payload, octet_length(encode(text)) AS nbytes
  FROM documents)"""

FLAT = (
    DOCS
    + """,
flat AS (
  SELECT 'doc-' || lang AS buffer_id, encode(string_agg(text, '' ORDER BY doc_id)) AS body FROM documents GROUP BY lang)"""
)

BUFFERS = """
declared AS (
  SELECT s_suppkey AS k, 'ns-' || (s_nationkey % 5) AS namespace, 'wb-' || s_suppkey AS name,
         CASE WHEN s_suppkey % 23 = 22 THEN ''
              ELSE (1 + s_suppkey % 97) || (['Gi','Mi','G','M','','Ti','GiB'])[CAST(s_suppkey % 7 AS INTEGER) + 1] END AS capacity,
         '/models/' || s_suppkey AS source_path,
         CAST(s_suppkey % 9 AS INTEGER) AS n, s_suppkey % 11 <> 10 AS sharded,
         CASE WHEN s_suppkey % 5 = 1 THEN 'model-*-of-*.safetensors' ELSE '' END AS file_pattern,
         CASE WHEN s_suppkey % 5 = 2 OR s_suppkey % 35 = 1
              THEN s_suppkey % 9 + (CASE WHEN s_suppkey % 25 = 2 THEN 1 ELSE 0 END) ELSE 0 END AS n_files
  FROM supplier),
files AS (
  SELECT k, i,
         CASE WHEN i = n_files - 1 AND k % 25 = 7 THEN n WHEN i = n_files - 1 AND k % 25 = 12 THEN 0 ELSE i END AS idx,
         '/models/' || k || '/part-' || i AS path, (i + 1) * 1000 AS size_bytes
  FROM (SELECT k, n, n_files, unnest(range(0, n_files)) AS i FROM declared)),
buffers AS (
  SELECT *,
    CASE regexp_extract(capacity, '^([0-9]+)(Gi|Mi|Ti|G|M|)$', 2)
      WHEN 'Gi' THEN 1073741824 WHEN 'Mi' THEN 1048576 WHEN 'Ti' THEN 1099511627776
      WHEN 'G' THEN 1000000000 WHEN 'M' THEN 1000000 ELSE 1 END
      * TRY_CAST(nullif(regexp_extract(capacity, '^([0-9]+)(Gi|Mi|Ti|G|M|)$', 1), '') AS BIGINT) AS capacity_bytes,
    (SELECT count(*) FROM files f WHERE f.k = declared.k AND (f.idx < 0 OR f.idx >= n)) AS stray,
    (SELECT arg_min(f.idx, f.i) FROM files f WHERE f.k = declared.k AND (f.idx < 0 OR f.idx >= n)) AS stray_index,
    (SELECT count(DISTINCT f.idx) FROM files f WHERE f.k = declared.k) AS distinct_files
  FROM declared)"""

VALIDATED = (
    BUFFERS
    + f""",
judged AS (
  SELECT *,
    CASE WHEN NOT sharded THEN NULL
         WHEN n <= 0 THEN {_q(MSG_NUM_SHARDS)}
         WHEN n_files > 0 AND file_pattern <> '' THEN {_q(MSG_EXCLUSIVE)} END AS invalid,
    CASE WHEN NOT sharded THEN NULL
         WHEN n_files > 0 AND n_files <> n
           THEN 'shardFiles count (' || n_files || ') does not match numShards (' || n || ')'
         WHEN n_files > 0 AND stray > 0 THEN 'shard index ' || stray_index || ' out of range [0, ' || n || ')'
         WHEN n_files > 0 OR file_pattern <> '' THEN NULL
         WHEN capacity = '' THEN {_q(MSG_NO_SOURCE)}
         WHEN capacity_bytes IS NULL THEN 'invalid capacity "' || capacity || '": '
           || (CASE WHEN regexp_matches(capacity, {_q(QUANTITY_FORMAT)}) THEN {_q(MSG_BAD_SUFFIX)} ELSE {_q(MSG_BAD_FORMAT)} END)
         END AS failed
  FROM buffers),
validated AS (
  SELECT *, sharded AND invalid IS NULL AND failed IS NULL AS ok,
         CASE WHEN sharded AND invalid IS NULL AND failed IS NULL THEN n ELSE 0 END AS total_shards
  FROM judged)"""
)

DISCOVERED = (
    VALIDATED
    + """,
places AS (SELECT *, CAST(i AS INTEGER) AS shard_index FROM (SELECT *, unnest(range(0, total_shards)) AS i FROM validated)),
discovered AS (
  SELECT namespace, name, shard_index,
    CASE WHEN n_files > 0 THEN coalesce((SELECT CAST(max(f.idx) AS INTEGER) FROM files f WHERE f.k = places.k AND f.idx = shard_index), 0)
         ELSE shard_index END AS stored_index,
    CASE WHEN n_files > 0 THEN coalesce((SELECT arg_max(f.path, f.i) FROM files f WHERE f.k = places.k AND f.idx = shard_index), '')
         WHEN file_pattern <> '' THEN source_path || '/model-' || lpad(CAST(shard_index + 1 AS VARCHAR), 5, '0') || '-of-'
           || lpad(CAST(total_shards AS VARCHAR), 5, '0') || '.safetensors'
         ELSE source_path END AS path,
    CAST(CASE WHEN n_files > 0 THEN coalesce((SELECT arg_max(f.size_bytes, f.i) FROM files f WHERE f.k = places.k AND f.idx = shard_index), 0)
         WHEN file_pattern <> '' THEN coalesce(capacity_bytes // total_shards, 0)
         ELSE capacity_bytes // total_shards + (CASE WHEN shard_index < capacity_bytes % total_shards THEN 1 ELSE 0 END)
         END AS BIGINT) AS size_bytes
  FROM places)"""
)

CLAIMS = f"""
targeted AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey,
         c_custkey % ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM supplier) // 10 + 1) AS target
  FROM customer),
claims AS (
  SELECT id, c_nationkey, t.name,
         CASE WHEN id % 17 = 0 THEN 'ns-wrong' ELSE 'ns-' || coalesce(s_nationkey % 5, 0) END AS namespace,
         'wb-' || target AS buffer_name,
         CASE WHEN id % 3 = 0 THEN CAST(id % 10 AS INTEGER) END AS shard_index,
         CASE id % 4 WHEN 1 THEN id % 10 WHEN 2 THEN id % 7 WHEN 3 THEN id % 10 END AS rank_index
  FROM targeted t LEFT JOIN supplier ON s_suppkey = target)"""

RESOURCE_CLAIMS = (
    CLAIMS
    + """,
rcs AS (
  SELECT id, namespace, name, 'u-' || id AS uid FROM claims WHERE id % 5 <> 0
  UNION ALL SELECT id, namespace, 'orphan-' || id, 'uo-' || id FROM claims WHERE id % 50 = 0)"""
)

RESOLVED = (
    CLAIMS
    + ","
    + DISCOVERED
    + f""",
matched AS (
  SELECT c.*, v.name IS NOT NULL AS found, coalesce(v.sharded, false) AS is_sharded, v.total_shards, v.source_path,
         CASE WHEN v.sharded THEN coalesce(c.shard_index, c.rank_index) END AS idx
  FROM claims c LEFT JOIN validated v ON c.namespace = v.namespace AND c.buffer_name = v.name),
failed_claims AS (
  SELECT *,
    CASE WHEN NOT is_sharded THEN NULL
         WHEN total_shards <= 0 THEN {_q(MSG_NOT_DISCOVERED)}
         WHEN idx IS NULL THEN replace({_q(MSG_NO_RANK)}, '%s', name)
         WHEN idx < 0 OR idx >= total_shards THEN 'shardIndex ' || idx || ' out of range [0, ' || total_shards || ')'
    END AS error
  FROM matched),
resolved AS (
  SELECT m.namespace, m.name, m.found, m.is_sharded, m.error, m.total_shards,
         CASE WHEN is_sharded AND error IS NULL THEN CAST(idx AS INTEGER) END AS assigned_index,
         CASE WHEN is_sharded AND error IS NULL THEN coalesce(d.path, m.source_path) END AS shard_path,
         CASE WHEN is_sharded AND error IS NULL THEN coalesce(d.size_bytes, 0) END AS shard_bytes
  FROM failed_claims m
  LEFT JOIN discovered d ON m.namespace = d.namespace AND m.buffer_name = d.name AND m.idx = d.shard_index
                        AND m.error IS NULL),
conditions AS (
  SELECT namespace, name,
    CASE WHEN found AND error IS NULL THEN 'True' ELSE 'False' END AS status,
    CASE WHEN NOT found THEN 'BufferNotFound' WHEN error IS NOT NULL THEN 'ShardValidationFailed' ELSE 'BufferFound' END AS reason,
    CASE WHEN NOT found THEN {_q(MSG_NOT_FOUND)} WHEN error IS NOT NULL THEN error
         WHEN is_sharded THEN 'Validated. Assigned shard ' || assigned_index || ' of ' || total_shards || ' (path: '
           || shard_path || ', size: ' || shard_bytes || ' bytes)'
         ELSE {_q(MSG_FOUND)} END AS message,
    assigned_index, shard_path, shard_bytes
  FROM resolved)"""
)

STAGING = (
    RESOURCE_CLAIMS
    + ","
    + BUFFERS
    + """,
requests AS (SELECT c.namespace, c.name, 'u-' || c.id AS uid, n_name AS node FROM claims c JOIN nation ON c_nationkey = n_nationkey),
named AS (
  SELECT r.namespace, r.uid, r.node, coalesce(rc.name, r.name) AS claim
  FROM requests r LEFT JOIN rcs rc ON r.namespace = rc.namespace AND r.uid = rc.uid),
staging AS (
  SELECT q.namespace, q.uid, q.node, q.claim, coalesce(c.buffer_name, '') AS buffer,
         coalesce(b.source_path, '') AS source_path,
         coalesce(c.shard_index, -1) AS shard_index,
         CASE WHEN b.sharded THEN b.n ELSE 0 END AS total_shards,
         CAST(coalesce(CASE WHEN b.sharded AND b.n > 0 THEN b.capacity_bytes // b.n ELSE b.capacity_bytes END, 0) AS BIGINT) AS size_bytes
  FROM named q
  LEFT JOIN claims c ON q.namespace = c.namespace AND q.claim = c.name
  LEFT JOIN buffers b ON q.namespace = b.namespace AND c.buffer_name = b.name)"""
)

LIFECYCLE = """
lifecycle AS (
  SELECT 'node-' || (user_id % 8) AS node, 'c-' || (user_id % 40) AS claim, 'wb-' || (event_id % 12) AS buffer_id,
         CAST(CASE WHEN event_id % 12 < 6 THEN (event_id // 12) % 4 ELSE -1 END AS INTEGER) AS shard_index,
         CASE WHEN event_id % 12 < 6 THEN 4 ELSE 0 END AS total_shards,
         CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 'stage' ELSE 'unstage' END AS op,
         event_id % 53 <> 0 AS ok, event_id AS seq, (1 + event_id % 64) * 1048576 + event_id % 3 AS size_bytes
  FROM events)"""

HISTORY = (
    LIFECYCLE
    + """,
named AS (
  SELECT *, CASE WHEN shard_index >= 0 AND total_shards > 0 THEN buffer_id || '__shard_' || shard_index ELSE buffer_id END AS eid
  FROM lifecycle),
seen AS (
  SELECT *, lag(op) OVER w AS prev_op, lag(eid) OVER w AS prev_eid,
         lag(shard_index) OVER w AS prev_shard, lag(total_shards) OVER w AS prev_total
  FROM named WINDOW w AS (PARTITION BY node, claim ORDER BY seq)),
deltas AS (
  SELECT node, claim, seq, op, size_bytes,
         CASE WHEN op = 'stage' THEN eid ELSE prev_eid END AS effective_id,
         CASE WHEN op = 'stage' THEN shard_index ELSE prev_shard END AS shard_index,
         CASE WHEN op = 'stage' THEN total_shards ELSE prev_total END AS total_shards,
         CASE WHEN op = 'stage' THEN 1 ELSE -1 END AS delta
  FROM seen WHERE (op = 'stage' AND ok) OR (op = 'unstage' AND prev_op = 'stage')),
summed AS (
  SELECT *, sum(delta) OVER (PARTITION BY node, effective_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM deltas),
lowest AS (
  SELECT *, min(s) OVER (PARTITION BY node, effective_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS low FROM summed),
counted AS (
  SELECT *, CAST(s - least(0, low) AS BIGINT) AS ref_count FROM lowest),
history AS (
  SELECT *, ref_count = 0 AS freed
  FROM (SELECT *, lag(ref_count, 1, 0) OVER (PARTITION BY node, effective_id ORDER BY seq) AS before FROM counted)
  WHERE ref_count <> before)"""
)

LIVE = (
    HISTORY
    + """,
ends AS (
  SELECT node, effective_id, arg_max(ref_count, seq) AS ref_count,
         max(seq) FILTER (WHERE delta = 1 AND ref_count = 1) AS since_seq
  FROM history GROUP BY node, effective_id),
holders AS (
  SELECT node, eid AS effective_id, count(*) AS live_claims
  FROM (SELECT node, claim, arg_max(op, seq) AS op, arg_max(eid, seq) AS eid FROM named GROUP BY node, claim)
  WHERE op = 'stage' GROUP BY node, eid),
live AS (
  SELECT e.node, e.effective_id, e.ref_count, h.size_bytes, h.shard_index, h.total_shards, e.since_seq,
         e.ref_count - coalesce(live_claims, 0) AS leaked
  FROM ends e JOIN history h ON e.node = h.node AND e.effective_id = h.effective_id AND e.since_seq = h.seq
  LEFT JOIN holders o ON e.node = o.node AND e.effective_id = o.effective_id
  WHERE e.ref_count > 0)"""
)

SIGNALS = """
signals AS (
  SELECT 'wb-' || (user_id % 20) AS buffer_id, 'peer-' || user_id AS peer, event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'PRE_UPDATE' WHEN 'purchase' THEN 'READY' WHEN 'click' THEN 'METADATA'
                         WHEN 'signup' THEN 'CONNECT' ELSE 'DISCONNECT' END AS signal
  FROM events)"""

WINDOWS = (
    SIGNALS
    + """,
windows AS (
  SELECT buffer_id, seq, ts AS started_at, ended_at, signal FROM (
    SELECT *, min(CASE WHEN signal = 'READY' THEN ts END) OVER (
        PARTITION BY buffer_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended_at
    FROM signals)
  WHERE signal = 'PRE_UPDATE')"""
)

SUBS = (
    SIGNALS
    + """,
subs AS (
  SELECT c.buffer_id, c.peer, c.seq, c.ts AS connected_at,
         (SELECT min(d.ts) FROM signals d WHERE d.signal = 'DISCONNECT' AND d.buffer_id = c.buffer_id AND d.peer = c.peer
            AND (d.ts > c.ts OR (d.ts = c.ts AND d.seq > c.seq))) AS broken_at
  FROM signals c WHERE c.signal = 'CONNECT')"""
)

MATCHED = (
    SIGNALS
    + """,
ready AS (
  SELECT r.buffer_id, r.seq, r.ts,
    coalesce(
      (SELECT max(m.ts) FROM signals m WHERE m.signal = 'METADATA' AND m.buffer_id = r.buffer_id
         AND m.ts <= r.ts AND m.ts >= r.ts - INTERVAL 300 SECOND),
      (SELECT min(m.ts) FROM signals m WHERE m.signal = 'METADATA' AND m.buffer_id = r.buffer_id
         AND m.ts > r.ts AND m.ts <= r.ts + INTERVAL 300 SECOND)) AS meta
  FROM signals r WHERE r.signal = 'READY')"""
)

SESSIONS = (
    SIGNALS
    + """,
gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY buffer_id ORDER BY ts, seq) <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh
  FROM signals),
steps AS (SELECT *, sum(fresh) OVER (PARTITION BY buffer_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS step FROM gaps)"""
)

TRANSFERS = """
transfers AS (
  SELECT user_id AS run, event_id AS seq, value / 100 AS seconds, (1 + event_id % 75) * 1073741824 AS bytes,
         (['pack','propagate','metadata','total'])[CAST(event_id % 4 AS INTEGER) + 1] AS phase,
         CASE WHEN event_id % 2 = 1 THEN 'SCATTER' ELSE 'BROADCAST' END AS mode,
         CASE WHEN event_id % 2 = 1 AND event_id % 4 <> 3 THEN (1 + event_id % 75) * 1073741824 // 8 ELSE 0 END AS shard_length
  FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run, phase ORDER BY seq) - 1 AS iter FROM transfers)"""

CONDITION_UPDATES = """
updates AS (
  SELECT 'obj-' || (user_id % 30) AS object_id, CASE WHEN event_id % 2 = 0 THEN 'Ready' ELSE 'Validated' END AS type,
         CASE WHEN value > 100 THEN 'True' ELSE 'False' END AS status, event_type AS reason, event_id AS seq,
         epoch_us(ts) AS ts
  FROM events),
ordered AS (SELECT *, lag(status) OVER (PARTITION BY object_id, type ORDER BY seq) AS previous FROM updates),
transitions AS (SELECT * FROM ordered WHERE previous IS NULL OR previous <> status)"""

SNAPSHOTS = """
snaps AS (
  SELECT 'node-' || (user_id % 8) AS node, ts, 40960 + event_id % 1024 AS memory_mib, event_id AS seq
  FROM events WHERE event_id % 20 <> 0)"""

HALF = """
halves AS (
  SELECT 'doc-' || lang AS buffer_id, doc_id AS ordinal, hex(encode(text)) AS h, octet_length(encode(text)) AS nbytes FROM documents),
words AS (
  SELECT buffer_id, ordinal, CAST('0x' || substr(h, i * 4 + 3, 2) || substr(h, i * 4 + 1, 2) AS INTEGER) AS w
  FROM (SELECT *, unnest(range(0, nbytes // 2)) AS i FROM halves WHERE nbytes % 2 = 0)),
numbers AS (
  SELECT buffer_id, ordinal, (w >> 10) & 31 AS e,
         (CASE WHEN w >= 32768 THEN -1 ELSE 1 END) * (CASE WHEN (w >> 10) & 31 = 0 THEN (w & 1023) / CAST(16777216 AS DOUBLE)
           ELSE (1024 + (w & 1023)) * pow(CAST(2 AS DOUBLE), ((w >> 10) & 31) - 25) END) AS x
  FROM words),
sums AS (
  SELECT buffer_id, ordinal, count(*) AS elements, count(*) FILTER (WHERE e <> 31) AS finite,
         sum(x) FILTER (WHERE e <> 31) AS total
  FROM numbers GROUP BY buffer_id, ordinal)"""


def _inventory() -> str:
    return """
nodes AS (
  SELECT n_name AS node, 1 + n_nationkey % 8 AS gpu_count, CAST(40960 + 1024 * n_nationkey AS BIGINT) * 1048576 AS memory_bytes
  FROM nation WHERE n_nationkey % 10 <> 9)"""


def _quantities() -> str:
    """Both spellings of the quantity query: balances with a suffix, and declared capacities."""
    return (
        BUFFERS
        + """,
spelled AS (
  SELECT s_suppkey AS id, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS cents,
         CASE s_suppkey % 13 WHEN 12 THEN '-' WHEN 11 THEN '+' ELSE '' END AS sign,
         (['','Ki','Mi','Gi','Ti','Pi','k','M','G','T','m','u','e3','E2','KB','gi'])[CAST(s_suppkey % 16 AS INTEGER) + 1] AS suffix
  FROM supplier),
valued AS (
  SELECT id, sign || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || suffix AS quantity,
         CASE suffix WHEN '' THEN CAST(cents AS HUGEINT) WHEN 'Ki' THEN CAST(cents AS HUGEINT) * 1024
           WHEN 'Mi' THEN CAST(cents AS HUGEINT) * 1048576 WHEN 'Gi' THEN CAST(cents AS HUGEINT) * 1073741824
           WHEN 'Ti' THEN CAST(cents AS HUGEINT) * 1099511627776 WHEN 'Pi' THEN CAST(cents AS HUGEINT) * 1125899906842624
           WHEN 'k' THEN CAST(cents AS HUGEINT) * 1000 WHEN 'M' THEN CAST(cents AS HUGEINT) * 1000000
           WHEN 'G' THEN CAST(cents AS HUGEINT) * 1000000000 WHEN 'T' THEN CAST(cents AS HUGEINT) * 1000000000000
           WHEN 'm' THEN CAST(cents AS HUGEINT) WHEN 'u' THEN CAST(cents AS HUGEINT)
           WHEN 'e3' THEN CAST(cents AS HUGEINT) * 1000 WHEN 'E2' THEN CAST(cents AS HUGEINT) * 100 END AS scaled,
         CASE suffix WHEN 'm' THEN 100000 WHEN 'u' THEN 100000000 ELSE 100 END AS unit, sign
  FROM spelled)"""
    )


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["model_size"] = f"""WITH {TENSORS}
SELECT buffer_id, count(*) AS tensors, CAST(sum(numel) AS BIGINT) AS params, CAST(sum(nbytes) AS BIGINT) AS total_bytes,
       CAST(floor(CAST(sum(nbytes) AS DOUBLE) * CAST(1.05 AS DOUBLE)) AS BIGINT) AS buffer_bytes
FROM tensors GROUP BY buffer_id"""

    sql["pack_offsets"] = f"WITH {PACKED} SELECT buffer_id, name, position, byte_offset, nbytes FROM packed"

    sql["pack_overflow"] = f"""WITH {PACKED}
SELECT buffer_id, arg_min(name, byte_offset) AS name, min(byte_offset) AS byte_offset,
       arg_min(nbytes, byte_offset) AS nbytes, CAST(131072 AS BIGINT) AS capacity
FROM packed WHERE byte_offset + nbytes > 131072 GROUP BY buffer_id"""

    sql["split_shards"] = f"WITH {TENSORS}, {SHARDS} SELECT * FROM shards ORDER BY buffer_id, shard_index"

    sql["tensors_in_shards"] = f"""WITH {PACKED}, {SHARDS}
SELECT t.buffer_id, s.shard_index, t.name,
       greatest(byte_offset, offset_bytes) - byte_offset AS src_start,
       greatest(byte_offset, offset_bytes) - offset_bytes AS dst_start,
       least(byte_offset + nbytes, offset_bytes + size_bytes) - greatest(byte_offset, offset_bytes) AS length
FROM packed t JOIN shards s ON t.buffer_id = s.buffer_id
 AND byte_offset < offset_bytes + size_bytes AND offset_bytes < byte_offset + nbytes"""

    sql["update_info_roundtrip"] = f"""WITH {PACKED}
SELECT buffer_id, position // 256 AS part, CAST(position % 256 AS INTEGER) AS "index", name, dtype,
       d0 || 'x' || d1 AS shape, byte_offset,
       max(byte_offset + nbytes) OVER (PARTITION BY buffer_id, position // 256) AS total_bytes
FROM packed"""

    sql["update_info_check"] = f"""WITH {PACKED},
parts AS (SELECT buffer_id, position // 256 AS part, any_value(l_suppkey) % 5 AS kind, CAST(count(*) AS INTEGER) AS tensors
          FROM packed GROUP BY buffer_id, position // 256)
SELECT buffer_id, part, tensors,
       CASE WHEN kind BETWEEN 1 AND 3 THEN '`' || (['dtype_names','shapes','offsets'])[CAST(kind AS INTEGER)]
         || '` should be of the same size as `names`: ' || (tensors - 1) || ' vs ' || tensors END AS reason
FROM parts"""

    sql["scatter_plan"] = f"""WITH {TENSORS}, {TOTALS},
sized AS (SELECT *, CASE WHEN CAST(substr(buffer_id, 4) AS BIGINT) % 2 = 0 THEN 4 ELSE 8 END AS n FROM totals)
SELECT buffer_id, '10.0.' || n || '.' || i AS target_node, buffer_id || '__shard_' || i AS target_buffer,
       CAST(i AS INTEGER) AS shard_index, CAST(i + 1 AS INTEGER) AS "rank", i * (total_bytes // n) AS offset_bytes,
       total_bytes // n AS length_bytes, CAST(i AS INTEGER) AS target_gpu
FROM (SELECT *, unnest(range(0, n)) AS i FROM sized)"""

    sent = """sent AS (SELECT buffer_id, total_bytes, n_name AS target_node FROM totals JOIN nation
         ON CAST(substr(buffer_id, 4) AS BIGINT) % 5 = n_nationkey % 5)"""
    sql["broadcast_ranges"] = f"""WITH {TENSORS}, {TOTALS}, {sent}
SELECT buffer_id, target_node, total_bytes, CAST(16384 AS BIGINT) AS chunk_bytes,
       CAST((total_bytes + 16383) // 16384 AS BIGINT) AS chunks FROM sent"""

    sql["broadcast_plan"] = f"""WITH {TENSORS}, {TOTALS}, {sent}
SELECT buffer_id, target_node, c AS chunk_no, c * 16384 AS byte_start, least(16384, total_bytes - c * 16384) AS length
FROM (SELECT *, unnest(range(0, (total_bytes + 16383) // 16384)) AS c FROM sent)"""

    sql["pack_chunks"] = f"""WITH {FLAT}
SELECT buffer_id, c AS chunk_no, c * 65536 AS byte_start,
       CAST(octet_length(array_slice(body, c * 65536 + 1, c * 65536 + 65536)) AS INTEGER) AS length,
       sha256(array_slice(body, c * 65536 + 1, c * 65536 + 65536)) AS sha256
FROM (SELECT *, unnest(range(0, (octet_length(body) + 65535) // 65536)) AS c FROM flat)"""

    for key in ("unpack_roundtrip", "payload_checksums"):
        sql[key] = f"WITH {DOCS} SELECT buffer_id, ordinal, sha256(payload) AS sha256 FROM docs"

    sql["payload_crc32"] = f"""WITH {DOCS},
crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS steps),
raw AS (
  SELECT buffer_id, ordinal, steps, list_transform(range(nbytes), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT *, hex(payload) AS h FROM docs), crc)
SELECT buffer_id, ordinal,
       CAST(xor(list_reduce([4294967295] || b, lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS BIGINT) AS crc32
FROM raw"""

    sql["piece_digests"] = f"""WITH {DOCS},
placed AS (
  SELECT *, CAST(coalesce(sum(nbytes) OVER (PARTITION BY buffer_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo
  FROM docs),
cut AS (
  SELECT buffer_id, ordinal, payload, lo, nbytes, lo // 1025 AS first,
         unnest(range(lo // 1025, greatest((lo + nbytes - 1) // 1025, lo // 1025) + 1)) AS c FROM placed),
leaf AS (
  SELECT buffer_id, ordinal, c - first AS pos,
         array_slice(payload, greatest(c * 1025 - lo, 0) + 1, least((c + 1) * 1025 - lo, nbytes)) AS bytes FROM cut),
l1 AS (
  SELECT buffer_id, ordinal, pos // 4096 AS pos, sha256(string_agg(sha256(bytes), '' ORDER BY pos)) AS hex,
         count(*) AS pieces, sum(octet_length(bytes)) AS nbytes FROM leaf GROUP BY buffer_id, ordinal, pos // 4096)
SELECT buffer_id, ordinal, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(nbytes) AS BIGINT) AS nbytes,
       sha256(string_agg(hex, '' ORDER BY pos)) AS digest FROM l1 GROUP BY buffer_id, ordinal"""

    sql["scatter_bytes"] = f"""WITH {FLAT},
parts AS (SELECT *, unnest(range(0, 4)) AS i, octet_length(body) // 4 AS each FROM flat),
pieces AS (
  SELECT buffer_id || '__shard_' || i AS target_buffer, CAST(i AS INTEGER) AS shard_index, body,
         greatest(c * 65536, i * each) AS lo, least(c * 65536 + 65536, (i + 1) * each) AS hi
  FROM (SELECT *, unnest(range((i * each) // 65536, ((i + 1) * each - 1) // 65536 + 1)) AS c FROM parts WHERE each > 0))
SELECT target_buffer, shard_index, lo AS byte_start, CAST(hi - lo AS INTEGER) AS length,
       sha256(array_slice(body, lo + 1, hi)) AS sha256
FROM pieces"""

    sql["verify_replicas"] = f"""WITH {DOCS}
SELECT buffer_id, 't.' || ordinal AS name,
       CASE WHEN ordinal % 83 = 0 THEN 'MISSING_LEFT' WHEN ordinal % 89 = 0 THEN 'MISSING_RIGHT'
            WHEN ordinal % 97 = 0 THEN 'DIFF' ELSE 'MATCH' END AS verdict
FROM docs WHERE NOT (ordinal % 83 = 0 AND ordinal % 89 = 0)"""

    sql["buffer_digests"] = f"""WITH {DOCS},
leaf AS (SELECT buffer_id, sha256(payload) AS hex, row_number() OVER (PARTITION BY buffer_id ORDER BY ordinal) - 1 AS pos FROM docs),
l1 AS (SELECT buffer_id, pos // 4096 AS pos, sha256(string_agg(hex, '' ORDER BY pos)) AS hex FROM leaf GROUP BY buffer_id, pos // 4096),
l2 AS (SELECT buffer_id, pos // 4096 AS pos, sha256(string_agg(hex, '' ORDER BY pos)) AS hex FROM l1 GROUP BY buffer_id, pos // 4096)
SELECT buffer_id, sha256(string_agg(hex, '' ORDER BY pos)) AS digest FROM l2 GROUP BY buffer_id"""

    sql["tensor_stats"] = """SELECT 'emb-' || label AS buffer_id, vec_id AS ordinal, CAST(len(embedding) AS BIGINT) AS elements,
       true AS all_finite, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) + 1e-9, 6) AS mean,
       array_to_string(list_transform(embedding[1:10], lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ',') AS "first"
FROM embeddings"""

    for key in ("typed_view_stats", "typed_view_pieces"):
        sql[key] = f"""WITH {HALF}
SELECT h.buffer_id, h.ordinal,
       CASE WHEN nbytes % 2 <> 0 THEN nbytes || ' bytes is not a multiple of 2' END AS error,
       CASE WHEN nbytes % 2 = 0 THEN CAST(coalesce(elements, 0) AS INTEGER) END AS elements,
       CASE WHEN nbytes % 2 = 0 THEN CAST(coalesce(finite, 0) AS INTEGER) END AS finite,
       round(total / finite + 1e-9, 6) AS mean
FROM halves h LEFT JOIN sums s ON h.buffer_id = s.buffer_id AND h.ordinal = s.ordinal"""

    sql["validate_buffers"] = f"""WITH {VALIDATED}
SELECT namespace, name, capacity, source_path,
       CASE WHEN sharded THEN CASE WHEN ok THEN 'True' ELSE 'False' END END AS status,
       CASE WHEN sharded THEN CASE WHEN invalid IS NOT NULL THEN 'InvalidSpec' WHEN failed IS NOT NULL THEN 'DiscoveryFailed'
            ELSE 'ShardsDiscovered' END END AS reason,
       CASE WHEN sharded THEN coalesce(invalid, failed, 'Discovered ' || n || ' shards') END AS message,
       total_shards, ok AND distinct_files < n_files AS dup_index,
       'True' AS ready_status, 'BufferCreated' AS ready_reason, {_q(MSG_READY)} AS ready_message
FROM validated"""

    sql["discovered_shards"] = f"WITH {DISCOVERED} SELECT * FROM discovered ORDER BY namespace, name, shard_index"

    sql["parse_quantity"] = f"""WITH {_quantities()}
SELECT id, quantity, CASE WHEN scaled IS NOT NULL THEN CAST((CASE sign WHEN '-' THEN -1 ELSE 1 END)
         * least(CAST(9223372036854775807 AS HUGEINT), (scaled + unit - 1) // unit) AS BIGINT) END AS bytes FROM valued
UNION ALL SELECT k, capacity, capacity_bytes FROM buffers"""

    sql["align_up"] = f"""WITH {BUFFERS},
staged AS (SELECT name, coalesce(nullif(capacity_bytes, 0), 10737418240) AS staged,
                  CASE WHEN sharded AND n > 0 THEN n * 4096 ELSE 2097152 END AS g FROM buffers)
SELECT name, staged, (staged + 2097151) // 2097152 * 2097152 AS aligned, (staged + g - 1) // g * g AS aligned_own FROM staged"""

    sql["shard_files"] = f"""WITH {BUFFERS}
SELECT name, CAST(i AS INTEGER) AS shard_index,
       (CASE WHEN k % 10 = 4 THEN '' ELSE source_path || '/' END) || 'model-' || lpad(CAST(i + 1 AS VARCHAR), 5, '0') || '-of-'
         || lpad(CAST(n AS VARCHAR), 5, '0') || '.safetensors' AS path,
       coalesce(capacity_bytes // n, 0) AS size_bytes
FROM (SELECT *, unnest(range(0, n)) AS i FROM buffers WHERE sharded)"""

    sql["resolve_claims"] = f"""WITH {CLAIMS}, {BUFFERS}
SELECT c.namespace, c.name, c.buffer_name, b.name IS NOT NULL AS found,
       CASE WHEN b.name IS NOT NULL THEN 'BufferFound' ELSE 'BufferNotFound' END AS reason,
       CASE WHEN b.name IS NOT NULL THEN {_q(MSG_FOUND)} ELSE {_q(MSG_NOT_FOUND)} END AS message
FROM claims c LEFT JOIN buffers b ON c.namespace = b.namespace AND c.buffer_name = b.name"""

    sql["resolve_shards"] = f"WITH {RESOLVED} SELECT * FROM conditions"

    sql["shard_from_annotations"] = f"WITH {CLAIMS} SELECT id, name, rank_index AS shard FROM claims"

    sql["staging_requests"] = f"WITH {STAGING} SELECT * FROM staging"

    sql["over_capacity"] = f"""WITH {STAGING}, {_inventory()}
SELECT namespace, claim, s.node, size_bytes, memory_bytes,
       CASE WHEN size_bytes > memory_bytes THEN 'REJECT' ELSE 'ADMIT' END AS verdict
FROM staging s LEFT JOIN nodes n ON s.node = n.node"""

    sql["device_class_any"] = f"WITH {RESOURCE_CLAIMS} SELECT namespace, name, uid FROM rcs WHERE id % 3 <> 1 AND id % 4 <> 0"

    sql["reconcile_diff"] = f"""WITH {RESOLVED},
rcs AS (
  SELECT namespace, name FROM claims WHERE id % 5 <> 0
  UNION ALL SELECT namespace, 'orphan-' || id FROM claims WHERE id % 50 = 0),
want AS (SELECT namespace, name FROM conditions WHERE status = 'True')
SELECT namespace, name, 'CREATE' AS action FROM want w
WHERE NOT EXISTS (SELECT 1 FROM rcs r WHERE r.namespace = w.namespace AND r.name = w.name)
UNION ALL SELECT namespace, name, 'DELETE' FROM rcs r
WHERE NOT EXISTS (SELECT 1 FROM claims w WHERE r.namespace = w.namespace AND r.name = w.name)"""

    sql["effective_ids"] = f"""WITH {STAGING}
SELECT claim, buffer, shard_index, total_shards, shard_index >= 0 AND total_shards > 0 AS sharded,
       buffer || (CASE WHEN shard_index >= 0 AND total_shards > 0 THEN '__shard_' || shard_index ELSE '' END) AS effective_id,
       buffer AS base_id
FROM staging"""

    for key in ("refcount_history", "stream_ledger", "backfill_ledger"):
        sql[key] = f"WITH {HISTORY} SELECT node, effective_id, claim, seq, op, delta, ref_count, freed FROM history"

    sql["live_allocations"] = f"WITH {LIVE} SELECT * FROM live"

    sql["bytes_by_gpu"] = f"""WITH {LIVE}
SELECT node, gpu, count(*) AS buffers, CAST(sum((size_bytes + 2097151) // 2097152 * 2097152) AS BIGINT) AS bytes
FROM (SELECT l.*, CASE WHEN shard_index >= 0 AND total_shards > 0 AND n_nationkey IS NOT NULL
                       THEN shard_index % (1 + n_nationkey % 4) ELSE 0 END AS gpu
      FROM live l LEFT JOIN nation ON n_nationkey < 7 AND node = 'node-' || n_nationkey)
GROUP BY node, gpu"""

    sql["dedupe_staging"] = f"""WITH {LIFECYCLE}
SELECT node, claim, buffer_id, shard_index, min(seq) AS seq, count(*) AS requests FROM lifecycle WHERE op = 'stage'
GROUP BY node, claim, buffer_id, shard_index"""

    sql["stream_dedupe_staging"] = f"""WITH {LIFECYCLE}
SELECT DISTINCT node, claim, buffer_id, shard_index FROM lifecycle WHERE op = 'stage'"""

    for key in ("staging_in_horizon", "backfill_staging"):
        sql[key] = f"""WITH RECURSIVE {LIFECYCLE},
stages AS (SELECT l.*, epoch_us(e.ts) AS us FROM lifecycle l JOIN events e ON l.seq = e.event_id WHERE op = 'stage'),
kept AS (
  SELECT node, claim, buffer_id, shard_index, min(us) AS us FROM stages GROUP BY node, claim, buffer_id, shard_index
  UNION ALL
  SELECT k.node, k.claim, k.buffer_id, k.shard_index, min(s.us) AS us FROM kept k
  JOIN stages s ON s.node = k.node AND s.claim = k.claim AND s.buffer_id = k.buffer_id AND s.shard_index = k.shard_index
   AND s.us > k.us + 172800000000
  GROUP BY k.node, k.claim, k.buffer_id, k.shard_index)
SELECT s.node, s.claim, s.buffer_id, s.shard_index, min(s.seq) AS seq, arg_min(total_shards, s.seq) AS total_shards,
       arg_min(ok, s.seq) AS ok, arg_min(size_bytes, s.seq) AS size_bytes, s.us AS ts
FROM stages s JOIN kept k USING (node, claim, buffer_id, shard_index, us)
GROUP BY s.node, s.claim, s.buffer_id, s.shard_index, s.us"""

    sql["update_windows"] = f"""WITH {WINDOWS}
SELECT buffer_id, seq, epoch_us(started_at) AS started_at, epoch_us(ended_at) AS ended_at,
       (epoch_us(ended_at) - epoch_us(started_at)) / CAST(1000000 AS DOUBLE) AS seconds, ended_at IS NULL AS is_open
FROM windows"""

    for key in ("update_timeouts", "stream_update_timeouts"):
        sql[key] = f"""WITH {WINDOWS}
SELECT buffer_id, seq, epoch_us(started_at) AS started_at, 'TIMEOUT' AS outcome FROM windows
WHERE ended_at IS NULL OR ended_at - started_at > INTERVAL 300 SECOND"""

    for key in ("ready_metadata", "stream_ready_metadata"):
        sql[key] = f"""WITH {MATCHED}
SELECT buffer_id, seq, epoch_us(ts) AS ready_at, epoch_us(meta) AS metadata_at,
       CASE WHEN meta IS NOT NULL THEN epoch_us(greatest(ts, meta)) END AS complete_at, meta IS NOT NULL AS matched
FROM ready"""

    sql["deliver_signals"] = f"""WITH {SUBS}
SELECT r.buffer_id, r.seq, epoch_us(r.ts) AS ready_at, count(s.seq) AS receivers
FROM signals r LEFT JOIN subs s ON r.buffer_id = s.buffer_id AND s.connected_at <= r.ts
 AND (s.broken_at IS NULL OR s.broken_at > r.ts)
WHERE r.signal = 'READY' GROUP BY r.buffer_id, r.seq, r.ts"""

    sql["subscription_receipts"] = f"""WITH {SUBS}
SELECT s.buffer_id, s.peer, s.seq, count(r.seq) AS delivered
FROM subs s LEFT JOIN signals r ON r.signal = 'READY' AND r.buffer_id = s.buffer_id AND s.connected_at <= r.ts
 AND (s.broken_at IS NULL OR s.broken_at > r.ts)
GROUP BY s.buffer_id, s.peer, s.seq"""

    for key in ("step_sessions", "stream_step_sessions"):
        sql[key] = f"""WITH {SESSIONS}
SELECT buffer_id, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS ended_at, count(*) AS signals,
       count(*) FILTER (WHERE signal = 'READY') AS updates,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS seconds
FROM steps GROUP BY buffer_id, step"""

    sql["latency_summary"] = f"""WITH {TRANSFERS},
samples AS (
  SELECT run, phase, seconds AS v, 1000 AS scale FROM numbered WHERE iter >= 3
  UNION ALL SELECT run, 'bandwidth_gbs', bytes / CAST(1073741824 AS DOUBLE) / seconds, 1 FROM numbered
  WHERE iter >= 3 AND phase = 'total' AND seconds > 0),
sorted AS (SELECT run, phase, scale, list(v ORDER BY v) AS vs, count(*) AS n, avg(v) AS m, median(v) AS med,
                  min(v) AS lo, max(v) AS hi, coalesce(stddev_samp(v), 0) AS sd FROM samples GROUP BY run, phase, scale)
SELECT run, phase, n, round(m * scale + 1e-9, 6) AS mean, round(med * scale + 1e-9, 6) AS median, round(med * scale + 1e-9, 6) AS p50,
       round(CASE WHEN n >= 20 THEN vs[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] ELSE hi END * scale + 1e-9, 6) AS p95,
       round(lo * scale + 1e-9, 6) AS min, round(hi * scale + 1e-9, 6) AS max, round(sd * scale + 1e-9, 6) AS stddev
FROM sorted"""

    sql["mean_transfer"] = f"""WITH {TRANSFERS}
SELECT run, count(*) AS n, round(sum(seconds) + 1e-9, 6) AS wall_seconds, round(sum(seconds) / count(*) + 1e-9, 6) AS mean_seconds,
       round(sum(bytes) / CAST(1073741824 AS DOUBLE) / nullif(sum(seconds), 0) + 1e-9, 6) AS gbps
FROM numbered WHERE iter >= 5 GROUP BY run"""

    sql["concurrent_streams"] = f"""WITH {TRANSFERS}
SELECT run, count(*) AS streams, round(avg(seconds) + 1e-9, 6) AS avg_seconds, round(max(seconds) + 1e-9, 6) AS max_seconds,
       round(sum(bytes) / CAST(1073741824 AS DOUBLE) + 1e-9, 6) AS total_gib,
       round(sum(bytes) / CAST(1073741824 AS DOUBLE) / nullif(max(seconds), 0) + 1e-9, 6) AS aggregate_gbps,
       round(sum(bytes) / CAST(1073741824 AS DOUBLE) / count(*) / nullif(avg(seconds), 0) + 1e-9, 6) AS per_stream_gbps,
       round(max(seconds) - min(seconds) + 1e-9, 6) AS spread_seconds,
       first(seq ORDER BY seconds, seq) AS fastest, last(seq ORDER BY seconds, seq) AS slowest
FROM transfers GROUP BY run"""

    sql["slowest_streams"] = f"""WITH {TRANSFERS}
SELECT run, seq AS stream, seconds, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seconds DESC, seq) AS place FROM transfers) WHERE place <= 3"""

    sql["sql_tensor_sizes"] = f"""WITH {TENSORS}
SELECT buffer_id, name, itemsize, numel, nbytes, CAST((nbytes + 255) // 256 * 256 AS BIGINT) AS aligned FROM (
  SELECT buffer_id, name, CAST(nbytes // numel AS INTEGER) AS itemsize, numel, nbytes FROM (
    SELECT *, CAST(l_quantity AS BIGINT) * (1 + l_partkey % 8) AS numel FROM tensors))"""

    for key in ("transfer_rates", "sql_transfer_rates"):
        sql[key] = f"""WITH {TRANSFERS},
moved AS (SELECT *, CASE WHEN shard_length > 0 THEN shard_length ELSE bytes END AS received_bytes,
                 CASE WHEN mode = 'SCATTER' THEN 7 * (bytes // 8) ELSE bytes END AS sent_bytes FROM transfers)
SELECT seq, mode, received_bytes, bytes AS logged_bytes, sent_bytes,
       CASE WHEN seconds > 0 THEN round(received_bytes / CAST(1073741824 AS DOUBLE) / seconds + 1e-9, 6) ELSE 0 END AS received_gbps,
       CASE WHEN seconds > 0 THEN round(bytes / CAST(1073741824 AS DOUBLE) / seconds + 1e-9, 6) ELSE 0 END AS logged_gbps,
       CASE WHEN seconds > 0 THEN round(received_bytes / CAST(1073741824 AS DOUBLE) / seconds / 50 * 100 + 1e-9, 6) ELSE 0 END AS pct_of_line
FROM moved"""

    sql["log_parse"] = """WITH lines AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) AS t FROM events)
SELECT epoch_us(date_trunc('millisecond', ts)) AS ts, 'INFO' AS level, CASE WHEN event_id % 3 = 0 THEN 'Source' ELSE 'Target' END AS role,
       CASE WHEN event_id % 2 = 1 THEN 'SCATTER' ELSE 'BROADCAST' END AS mode, t / CAST(10000 AS DOUBLE) AS seconds,
       floor((1 + event_id % 75) / (t / CAST(10000 AS DOUBLE)) * 100) / CAST(100 AS DOUBLE) AS gbps
FROM lines WHERE event_type <> 'error' AND t > 0"""

    sql["gpu_inventory"] = f"""WITH {_inventory()}
SELECT node, '{DEVICE_NAME_PREFIX}' || i AS device, memory_bytes FROM (SELECT *, unnest(range(0, gpu_count)) AS i FROM nodes)"""

    sql["inventory_errors"] = "SELECT n_name AS node, 'empty report' AS error FROM nation WHERE n_nationkey % 10 = 9"

    for key in ("device_snapshots", "stream_device_snapshots"):
        sql[key] = f"""WITH {SNAPSHOTS}
SELECT node, epoch_us(ts) // 30000000 * 30000000 AS interval_start, arg_max(memory_mib, ts) AS memory_mib,
       arg_max(seq, ts) AS seq, count(*) AS reads
FROM snaps GROUP BY node, epoch_us(ts) // 30000000"""

    sql["upsert_slices"] = f"""WITH {SNAPSHOTS}
SELECT node, max(seq) AS seq, arg_max(memory_mib, seq) AS memory_mib, epoch_us(arg_max(ts, seq)) AS ts
FROM snaps WHERE seq % 3 = 0 OR node <> 'node-7' GROUP BY node"""

    sql["condition_latest"] = f"""WITH {CONDITION_UPDATES},
stored AS (SELECT * FROM updates WHERE type = 'Ready' UNION ALL SELECT * EXCLUDE (previous) FROM transitions WHERE type = 'Validated')
SELECT object_id, type, arg_max(status, seq) AS status, arg_max(reason, seq) AS reason, max(seq) AS seq, arg_max(ts, seq) AS ts
FROM stored GROUP BY object_id, type"""

    sql["condition_transitions"] = f"WITH {CONDITION_UPDATES} SELECT * FROM transitions"

    sql["stream_conditions"] = sql["condition_latest"]

    return sql
