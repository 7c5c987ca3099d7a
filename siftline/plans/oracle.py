"""The parse engine in DuckDB's SQL: what the queries' results are held against."""

from __future__ import annotations

from siftline.operators import parse as P
from siftline.plans.lines import ARROW_PATTERN, DUCKDB_LINES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(map(q, values))


def u16(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '^\\+?[0-9]{{1,10}}$') AND TRY_CAST({v} AS BIGINT) <= 65535 THEN TRY_CAST({v} AS INTEGER) END"


def protocol(v: str) -> str:
    return f"CASE {v} WHEN '17' THEN 'UDP' WHEN '6' THEN 'TCP' WHEN '1' THEN 'ICMP' ELSE upper({v}) END"


def unquote(v: str) -> str:
    return f"""regexp_replace(regexp_replace({v}, '^"(.*)"$', '\\1'), '^''(.*)''$', '\\1')"""


def at(keys: str, values: str, name: str) -> str:
    return f"{values}[nullif(list_position({keys}, {q(name)}), 0)]"


def status(p: str) -> str:
    has = [f"coalesce({p}{c} <> '', false)" for c in ("src", "dst", "act", "pro")]
    rest = f"({has[2]} OR {has[3]})"
    return f"CASE WHEN {has[0]} AND {has[1]} AND {rest} THEN 'parsed' WHEN {has[0]} OR {has[1]} OR {rest} THEN 'partial' ELSE 'failed' END"


def error(p: str, failed: str) -> str:
    return f"CASE WHEN coalesce({p}src, {p}dst, {p}pro, {p}act) IS NULL THEN {q(failed)} WHEN {p}status = 'partial' THEN {q(P.PARTIAL)} WHEN {p}status = 'failed' THEN {q(P.NOTHING)} END"


VENDOR_CASE = " ".join(
    f"WHEN vk[i] IN ({names(keys)})" + (f" AND ({u16('vv[i]')}) IS NOT NULL" if n.endswith("port") else "") + f" THEN {q(n)}" for n, keys in P.VENDOR_KEYS.items()
)
GENERIC_CASE = " ".join(f"WHEN lower(k) IN ({names(keys)}) THEN {q(n)}" for n, keys in P.GENERIC_KEYS.items()) + " " + " ".join(
    f"WHEN regexp_matches(lower(k), {q(words)}) THEN {q(n)}" for n, words in P.GENERIC_WORDS
)
V, G = (lambda n: at("vn", "vv", n)), (lambda n: unquote(at("gn", "gv", n)))
PICK = lambda c: f"CASE won WHEN 'V' THEN v_{c} WHEN 'G' THEN g_{c} WHEN 'R' THEN r_{c} END"
TRIED = lambda code, name, when: f"CASE WHEN {when} THEN '{name}: ' || coalesce({code}_error, 'failed') END"

#: ev: the canonical events of all lines; try: the same with what each parser made of them
ENGINE = f"""
WITH RECURSIVE lines AS ({DUCKDB_LINES}),
_cut AS (
  SELECT *,
    regexp_extract_all(raw, {q(P.VENDOR)}, 1) AS vk, regexp_extract_all(raw, {q(P.VENDOR)}, 2) AS vv,
    regexp_extract_all(raw, {q(P.GENERIC)}, 1) AS gk, regexp_extract_all(raw, {q(P.GENERIC)}, 2) AS gv,
    regexp_extract_all(raw, {q(P.IP_IN_TEXT)}, 1) AS ips
  FROM lines),
_named AS (
  SELECT *,
    list_transform(range(1, len(vk) + 1), lambda i: CASE {VENDOR_CASE} END) AS vn,
    list_transform(gk, lambda k: CASE {GENERIC_CASE} END) AS gn
  FROM _cut),
_fields AS (
  SELECT *,
    {V('src_ip')} AS v_src, {V('dst_ip')} AS v_dst, {u16(V('src_port'))} AS v_sp, {u16(V('dst_port'))} AS v_dp,
    {protocol(V('protocol'))} AS v_pro, {V('action')} AS v_act, {V('severity')} AS v_sev, CAST(NULL AS VARCHAR) AS v_dev, 'Sangfor' AS v_vendor, 'Firewall' AS v_product,
    try_strptime(concat(CAST(year(ingest_time) AS VARCHAR), ' ', regexp_replace(regexp_extract(raw, {q(P.SYSLOG_TIME)}, 1), '\\s+', ' ', 'g')), '%Y %b %d %H:%M:%S') AS v_time,
    coalesce({G('src_ip')}, CASE WHEN {G('src_ip')} IS NULL OR {G('dst_ip')} IS NULL THEN ips[1] END) AS g_src,
    coalesce({G('dst_ip')}, CASE WHEN {G('src_ip')} IS NULL OR {G('dst_ip')} IS NULL THEN ips[2] END) AS g_dst,
    {u16(G('src_port'))} AS g_sp, {u16(G('dst_port'))} AS g_dp,
    {protocol(f"coalesce({G('protocol')}, nullif(regexp_extract(raw, {q(P.PROTOCOL_HINT)}, 1), ''))")} AS g_pro,
    coalesce({G('action')}, nullif(regexp_extract(raw, {q(P.ACTION_HINT)}, 1), '')) AS g_act, {G('severity')} AS g_sev, {G('device_id')} AS g_dev,
    CAST(NULL AS VARCHAR) AS g_vendor, CAST(NULL AS VARCHAR) AS g_product, CAST(NULL AS TIMESTAMP) AS g_time,
    nullif(regexp_extract(raw, {q(ARROW_PATTERN)}, 2), '') AS r_src, nullif(regexp_extract(raw, {q(ARROW_PATTERN)}, 3), '') AS r_dst,
    CAST(NULL AS INTEGER) AS r_sp, CAST(NULL AS INTEGER) AS r_dp, CAST(NULL AS VARCHAR) AS r_pro, nullif(regexp_extract(raw, {q(ARROW_PATTERN)}, 4), '') AS r_act,
    CAST(NULL AS VARCHAR) AS r_sev, nullif(regexp_extract(raw, {q(ARROW_PATTERN)}, 1), '') AS r_dev, 'ArrowLine' AS r_vendor, CAST(NULL AS VARCHAR) AS r_product, CAST(NULL AS TIMESTAMP) AS r_time,
    lower(raw) LIKE '%sangfor%' OR lower(raw) LIKE '%日志类型%' OR lower(raw) LIKE '%nat类型%' AS detected, len(gk) > 0 AS gated
  FROM _named),
_rated AS (SELECT *, {status('v_')} AS v_status, {status('g_')} AS g_status, {status('r_')} AS r_status FROM _fields),
try AS (
  SELECT *, {error('v_', P.VENDOR_FAILED)} AS v_error, {error('g_', P.GENERIC_FAILED)} AS g_error, {error('r_', P.RULES_FAILED)} AS r_error,
    CASE WHEN detected AND v_status = 'parsed' THEN 'V' WHEN gated AND g_status = 'parsed' THEN 'G' WHEN r_status = 'parsed' THEN 'R' WHEN NOT detected AND v_status = 'parsed' THEN 'V'
         WHEN detected AND v_status = 'partial' THEN 'V' WHEN gated AND g_status = 'partial' THEN 'G' WHEN r_status = 'partial' THEN 'R' WHEN NOT detected AND v_status = 'partial' THEN 'V' END AS won
  FROM _rated),
ev AS (
  SELECT line_id, shape, sha256(concat(raw, CAST(epoch_us(ingest_time) * 1000 AS VARCHAR), source_addr)) AS event_id, ingest_time, source_addr,
    {PICK('dev')} AS device_id, {PICK('time')} AS event_time, {PICK('vendor')} AS vendor, {PICK('product')} AS product,
    {PICK('src')} AS src_ip, {PICK('sp')} AS src_port, {PICK('dst')} AS dst_ip, {PICK('dp')} AS dst_port, {PICK('pro')} AS protocol, {PICK('act')} AS action, {PICK('sev')} AS severity, raw,
    CASE won WHEN 'V' THEN v_status WHEN 'G' THEN g_status WHEN 'R' THEN r_status ELSE 'failed' END AS parse_status,
    CASE WHEN won IS NOT NULL THEN {PICK('error')}
         ELSE concat('no parser matched; attempted [', array_to_string(list_filter([{TRIED('v', P.VENDOR_NAME, 'detected')}, {TRIED('g', P.GENERIC_NAME, 'gated')}, {TRIED('r', P.RULES_NAME, 'true')}, {TRIED('v', P.VENDOR_NAME, 'NOT detected')}], lambda x: x IS NOT NULL), ', '), ']') END AS parse_error,
    CASE WHEN source_addr LIKE '%://%' THEN concat('source:', regexp_replace(source_addr, ':[0-9]+$', '')) ELSE concat('source:unknown:', substr(sha256(source_addr), 1, 8)) END AS scope_key
  FROM try)
"""
TIME = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
#: the events' columns with times as text
EVENT = ", ".join(f"{TIME(c)} AS {c}" if c in ("ingest_time", "event_time") else c for c in (
    "event_id", "ingest_time", "source_addr", "device_id", "event_time", "vendor", "product", "src_ip", "src_port", "dst_ip", "dst_port",
    "protocol", "action", "severity", "raw", "parse_status", "parse_error",
))
ROLLUP = """, rollup AS (
  SELECT date_trunc('minute', ingest_time) AS bucket_minute, coalesce(nullif(source_addr, ''), 'unknown') AS source_addr,
         coalesce(upper(nullif(protocol, '')), 'UNKNOWN') AS protocol, coalesce(lower(nullif(action, '')), 'unknown') AS action, parse_status,
         count(*) AS total_count, CAST(sum(length(raw)) AS BIGINT) AS raw_bytes
  FROM ev GROUP BY ALL)
"""
SUMS = "CAST(sum(total_count) AS BIGINT) AS total, " + ", ".join(
    f"CAST(coalesce(sum(total_count) FILTER (parse_status = '{s}'), 0) AS BIGINT) AS {s}" for s in ("parsed", "partial", "failed")
) + ", CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes"
