"""The registered queries on raw lines, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import net
from siftline.operators import joins, learn, metrics, parse, search
from siftline.operators.search import Search
from siftline.plans.lines import ARROW, lines
from siftline.plans.oracle import ENGINE, EVENT, ROLLUP, SUMS, TIME
from siftline.schema import EVENT_COLUMNS, RAW, RULE, SLIM_COLUMNS
from siftline.sources import sinks, tables
from siftline.streaming import stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2024, 12, 31)


def register(sql: str | None = None, base: str = ENGINE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = base + sql
        return f

    return add


def shown(df: DataFrame) -> DataFrame:
    """Times and dates as text, so that results compare alike in any time zone."""
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        elif kind == "date":
            df = df.withColumn(name, F.col(name).cast("string"))
    return df


def events(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return parse.parse_events(lines(spark, sf_dir), rules=[ARROW], **more)


def kept_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of all events, parsed once for queries that read them more than once."""
    return tables.kept(events(spark, sf_dir).select(*columns), "parsed")


#: what learned rules read and fill
_LEARNED = [*EVENT_COLUMNS, "scope_key"]


def rollup(spark, sf_dir) -> DataFrame:
    return metrics.minute_rollup(events(spark, sf_dir))


# ---------------------------------------------------------------- parsing

_V = "v_src AS src_ip, v_sp AS src_port, v_dst AS dst_ip, v_dp AS dst_port, v_pro AS protocol, v_act AS action, v_sev AS severity, v_status AS parse_status, v_error AS parse_error"


def _parser(df: DataFrame, column: str) -> DataFrame:
    names = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "action", "severity", "parse_status", "parse_error"]
    return df.select("line_id", *(F.col(f"{column}.{n}").alias(n) for n in names))


@register(f" SELECT line_id, {_V} FROM try")
def parse_vendor(spark, sf_dir):
    return _parser(parse.vendor_columns(lines(spark, sf_dir)), "vendor_result")


@register(f" SELECT line_id, {_V.replace('v_', 'g_')} FROM try")
def parse_generic(spark, sf_dir):
    return _parser(parse.generic_columns(lines(spark, sf_dir)), "generic_result")


@register(f" SELECT line_id, {_V.replace('v_', 'r_')} FROM try")
def parse_rules(spark, sf_dir):
    return _parser(parse.rule_columns(lines(spark, sf_dir), [ARROW]), "rules_result")


@register(f" SELECT {EVENT} FROM ev")
def parse_engine_events(spark, sf_dir):
    return shown(events(spark, sf_dir).select(EVENT_COLUMNS))


@register(" SELECT shape, parse_status, count(*) AS n FROM ev GROUP BY ALL")
def parse_engine_status(spark, sf_dir):
    return events(spark, sf_dir).groupBy("shape", "parse_status").agg(F.count("*").alias("n"))


@register(
    """, a AS (
      SELECT scope_key, 'parser:sangfor_nat_v1' AS parser_id, v_status AS s FROM try JOIN ev USING (line_id)
      UNION ALL SELECT scope_key, 'parser:generic_kv_v1', g_status FROM try JOIN ev USING (line_id) WHERE gated
      UNION ALL SELECT scope_key, 'parser:rule_based_v1', r_status FROM try JOIN ev USING (line_id))
    SELECT scope_key, parser_id, count(*) FILTER (s = 'parsed') AS success_count, count(*) FILTER (s = 'partial') AS partial_count,
           count(*) FILTER (s = 'failed') AS fail_count FROM a GROUP BY ALL"""
)
def parse_diagnostics_counts(spark, sf_dir):
    return learn.parser_profiles(events(spark, sf_dir, diagnostics=True)).drop("parser_name", "last_seen")


@register(" SELECT DISTINCT source_addr, scope_key FROM ev")
def source_scopes(spark, sf_dir):
    return lines(spark, sf_dir).select("source_addr", parse.source_scope(F.col("source_addr"))[0].alias("scope_key")).distinct()


_PAIR = parse.PAIR.replace("'", "''")


@register(f" SELECT line_id, CAST(len(regexp_extract_all(raw, '{_PAIR}', 1)) AS INTEGER) AS n_pairs, array_to_string(regexp_extract_all(raw, '{_PAIR}', 1), ',') AS keys, array_to_string(regexp_extract_all(raw, '{_PAIR}', 2), ',') AS vals FROM lines")
def kv_pairs(spark, sf_dir):
    keys, values, _, _ = parse.pairs(F.col("raw"))
    return lines(spark, sf_dir).select("line_id", F.size(keys).alias("n_pairs"), F.array_join(keys, ",").alias("keys"), F.array_join(values, ",").alias("vals"))


# ---------------------------------------------------------------- searches

_NEW = " ORDER BY ev.ingest_time DESC, ev.event_id DESC LIMIT "


def _search(name: str, what: Search, where: str):
    def f(spark, sf_dir):
        return shown(search.search_hot(events(spark, sf_dir), what).select(EVENT_COLUMNS))

    f.__name__ = name
    register(f" SELECT {EVENT} FROM ev WHERE {where}{_NEW}{what.limit}")(f)


_OK = "parse_status <> 'failed'"
_search("search_by_day", Search(day="20240103", limit=500), f"(CAST(ingest_time AS DATE) = DATE '2024-01-03' OR CAST(event_time AS DATE) = DATE '2024-01-03' OR raw LIKE '%20240103%') AND {_OK}")
_search("search_by_range", Search(date_from="2024-01-02", date_to="2024-01-05", limit=1000), f"CAST(coalesce(event_time, ingest_time) AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-05' AND {_OK}")
_search("search_by_device", Search(device="10.0.0.3", device_id="dev-3", limit=300), f"source_addr LIKE '%10.0.0.3%' AND device_id = 'dev-3' AND {_OK}")
_search("search_by_tuple", Search(dst_ip="8.8.8.8", protocol="17", action="ALLOW", limit=300), f"dst_ip = '8.8.8.8' AND upper(protocol) = 'UDP' AND lower(action) = 'allow' AND {_OK}")
_search("search_keyword", Search(keyword="NAT类型:snat", limit=300), f"raw LIKE '%NAT类型:snat%' AND {_OK}")
_search("search_include_failed", Search(include_failed=True, device="not a uri", limit=400), "source_addr LIKE '%not a uri%'")


@register(f" SELECT {EVENT.replace('raw,', chr(39) * 2 + ' AS raw,')} FROM ev{_NEW}1000")
def recent_events(spark, sf_dir):
    return shown(search.without_raw(search.newest(events(spark, sf_dir).select(EVENT_COLUMNS), 1000)))


@register(f" SELECT {', '.join(TIME(c) + ' AS ' + c if c.endswith('_time') else c for c in SLIM_COLUMNS)} FROM ev")
def slim_projection(spark, sf_dir):
    return shown(search.slim(events(spark, sf_dir)))


@register(" SELECT event_id, CASE WHEN parse_status = 'parsed' THEN '' ELSE raw END AS raw, parse_status FROM ev")
def prune_raw(spark, sf_dir):
    return search.pruned_raw(events(spark, sf_dir)).select("event_id", "raw", "parse_status")


@register(f" SELECT event_id, CASE WHEN parse_status = 'parsed' THEN '' ELSE raw END AS raw FROM ev{_NEW}2000")
def compact_hot(spark, sf_dir):
    from siftline.operators.lifecycle import compacted

    return compacted(events(spark, sf_dir), newest_rows=2000, drop_raw=True).select("event_id", "raw")


@register(" SELECT event_id, raw FROM ev WHERE ingest_time >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 3 DAY")
def compact_days(spark, sf_dir):
    from siftline.operators.lifecycle import compacted

    return compacted(events(spark, sf_dir), days=3, as_of=datetime(2024, 1, 5)).select("event_id", "raw")


@register(" SELECT DISTINCT source_addr, CASE WHEN source_addr LIKE 'udp://%' THEN 'UDP' WHEN source_addr LIKE 'tcp://%' THEN 'TCP' ELSE 'Unknown' END AS transport, regexp_replace(source_addr, '^[a-z]+://', '') AS device FROM ev")
def source_display(spark, sf_dir):
    s = F.col("source_addr")
    return lines(spark, sf_dir).select("source_addr", search.transport(s).alias("transport"), search.device_name(s, F.col("raw")).alias("device")).distinct()


@register(" SELECT event_id, coalesce(device_id, '') AS device_id, coalesce(src_port, 0) AS src_port, coalesce(protocol, '') AS protocol, " + TIME("coalesce(event_time, ingest_time)") + " AS event_time FROM ev")
def history_mapping(spark, sf_dir):
    rows = search.to_history(events(spark, sf_dir))
    return shown(rows.select("event_id", "device_id", "src_port", "protocol", "event_time"))


# ---------------------------------------------------------------- rollups


@register(ROLLUP + f" SELECT {TIME('bucket_minute')} AS bucket_minute, source_addr, protocol, action, parse_status, total_count, raw_bytes FROM rollup")
def minute_rollup(spark, sf_dir):
    return shown(rollup(spark, sf_dir))


@register(ROLLUP + f" SELECT {TIME('bucket_minute')} AS bucket_minute, source_addr, protocol, action, parse_status, total_count, raw_bytes FROM rollup")
def minute_rollup_incremental(spark, sf_dir):
    """The rollup without the lines of the last shape, then refreshed with them."""
    everything = kept_events(spark, sf_dir, *metrics.KEYS[1:], "ingest_time", "raw", "shape")
    before, batch = everything.where("shape <> 7"), everything.where("shape = 7")
    return shown(metrics.refreshed_rollup(metrics.minute_rollup(before), everything, batch))


def _series(unit):
    return f" SELECT {TIME('bucket')} AS bucket, total, parsed, partial, failed, raw_bytes FROM (SELECT date_trunc('{unit}', bucket_minute) AS bucket, {SUMS} FROM rollup WHERE bucket_minute >= TIMESTAMP '2024-12-31 00:00:00' - INTERVAL 8784 HOUR GROUP BY 1) ORDER BY 1 DESC LIMIT "


@register(ROLLUP + _series("minute") + "1440")
def minute_series(spark, sf_dir):
    return shown(metrics.series(rollup(spark, sf_dir), "minute", 8784, 1440, AS_OF))


@register(ROLLUP + _series("hour") + "168")
def hour_series(spark, sf_dir):
    return shown(metrics.series(rollup(spark, sf_dir), "hour", 8784, 168, AS_OF))


_TOP = f"SELECT source_addr, {SUMS}, {TIME('max(bucket_minute)')} AS last_seen FROM rollup GROUP BY 1 ORDER BY total DESC, source_addr LIMIT 5"


@register(ROLLUP + _TOP)
def source_topk(spark, sf_dir):
    return shown(metrics.source_top(rollup(spark, sf_dir), 5))


@register(ROLLUP + f" SELECT * FROM (SELECT * FROM ({_TOP.replace('LIMIT 5', 'LIMIT 100')}) WHERE failed > 0 ORDER BY total DESC, source_addr LIMIT 8)")
def failing_sources(spark, sf_dir):
    return shown(metrics.failing_sources(metrics.source_top(rollup(spark, sf_dir), 100)))


@register(" SELECT count(*) AS total, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'partial') AS partial, count(*) FILTER (parse_status = 'failed') AS failed FROM ev")
def event_stats(spark, sf_dir):
    return metrics.event_stats(events(spark, sf_dir))


@register(" SELECT coalesce(parse_error, 'unknown') AS reason, count(*) AS n FROM (SELECT * FROM ev ORDER BY ingest_time DESC, event_id DESC LIMIT 10000) WHERE parse_status = 'failed' GROUP BY 1")
def parse_error_summary(spark, sf_dir):
    return metrics.parse_errors(events(spark, sf_dir))


def _history(name, unit, keys):
    def f(spark, sf_dir):
        return shown(metrics.history_view(events(spark, sf_dir), unit, keys))

    f.__name__ = name
    columns = ", ".join(f"coalesce({k}, '') AS {k}" for k in keys)
    register(f" SELECT {TIME(f'date_trunc({chr(39)}{unit}{chr(39)}, ingest_time)')} AS bucket, {columns}, count(*) AS total_count, CAST(sum(strlen(raw)) AS BIGINT) AS raw_bytes, {TIME('max(ingest_time)')} AS last_seen FROM ev GROUP BY {', '.join(map(str, range(1, len(keys) + 2)))}")(f)


_history("history_minute", "minute", ["source_addr", "protocol", "action", "parse_status"])
_history("history_source_hour", "hour", ["source_addr"])
_history("history_protocol_hour", "hour", ["protocol", "action"])


@register(f" SELECT source_addr, count(*) AS total_count, CAST(sum(strlen(raw)) AS BIGINT) AS raw_bytes, {TIME('max(ingest_time)')} AS last_seen FROM ev GROUP BY 1")
def summing_merge(spark, sf_dir):
    return shown(metrics.merged(metrics.history_view(events(spark, sf_dir), "hour", ["source_addr"]), ["source_addr"]))


@register(
    ROLLUP + f""", m AS ({_series('minute').replace(TIME('bucket') + ' AS bucket', 'bucket').rstrip()} 1440)
    SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(failed) AS BIGINT) AS failed,
           printf('%.1f', floor(1000 * CAST(sum(parsed) AS DOUBLE) / sum(total) + 0.5) / 10) AS success_rate,
           (SELECT max(total) FROM (SELECT total FROM m ORDER BY bucket DESC LIMIT 96)) AS peak FROM m"""
)
def overview_kpis(spark, sf_dir):
    return metrics.overview(tables.kept(metrics.series(rollup(spark, sf_dir), "minute", 8784, 1440, AS_OF), "minutes"))


@register(" SELECT DISTINCT lower(action) AS action FROM ev WHERE coalesce(action, '') <> ''")
def action_facets(spark, sf_dir):
    rows = kept_events(spark, sf_dir, "action", "parse_status")
    return metrics.action_facets(rows.where("parse_status = 'parsed'"), rows.where("parse_status <> 'parsed'"))


@register(" SELECT DISTINCT CAST(CAST(strptime(regexp_extract(raw, '((?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])', 1), '%Y-%m-%d') AS DATE) AS VARCHAR) AS day FROM lines WHERE shape IN (3, 7)")
def log_days(spark, sf_dir):
    return shown(metrics.log_days(lines(spark, sf_dir)))


# ---------------------------------------------------------------- joins

_DEVICES = [(f"fw-{i}", f"Firewall {i}", f"10.0.0.{i}", "udp" if i % 2 else "tcp", 514 if i % 2 else 1514, i != 4) for i in range(1, 8)] + [("fw-9", "Idle", "10.0.0.99", "udp", 514, True)]
_DEVICE_SQL = ", devices(id, name, host, protocol, port, enabled) AS (VALUES " + ", ".join(map(str, _DEVICES)) + ")"


def devices(spark) -> DataFrame:
    return spark.createDataFrame(_DEVICES, "id string, name string, host string, protocol string, port int, enabled boolean")


@register(_DEVICE_SQL + " SELECT event_id, ev.source_addr, coalesce(d.id, device_id) AS device_id FROM ev LEFT JOIN devices d ON d.enabled AND ev.source_addr = lower(d.protocol) || '://' || d.host || ':' || CAST(d.port AS VARCHAR)")
def device_backfill(spark, sf_dir):
    return joins.backfill_devices(events(spark, sf_dir), devices(spark)).select("event_id", "source_addr", "device_id")


@register(
    ROLLUP + _DEVICE_SQL + f""", top AS ({_TOP.replace('LIMIT 5', '')}), keys AS (SELECT id, name, host AS key FROM devices UNION SELECT id, name, host || ':' || CAST(port AS VARCHAR) FROM devices)
    SELECT coalesce(id, source_addr) AS device, coalesce(name, source_addr) AS name, CASE WHEN id IS NULL THEN 'observed' ELSE 'managed' END AS kind,
      {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in ('total', 'parsed', 'partial', 'failed', 'raw_bytes'))}, max(last_seen) AS last_seen
    FROM keys FULL JOIN top ON key = regexp_replace(source_addr, '^[a-z]+://', '') GROUP BY 1, 2, 3"""
)
def device_rollup(spark, sf_dir):
    return shown(joins.device_rollup(devices(spark), metrics.source_totals(rollup(spark, sf_dir))))


@register(" SELECT event_id FROM ev WHERE line_id % 3 <> 0")
def dedup_insert(spark, sf_dir):
    rows = kept_events(spark, sf_dir, "event_id", "line_id")
    return joins.new_events(rows.union(rows), rows.where("line_id % 3 = 0")).select("event_id")


_CIDRS = [(1, "2.61.0.0/16", "Office", True, False), (2, "172.18.4.0/22", "Lab", True, False), (3, "8.8.8.8", "Resolver", False, False), (4, "211.120.49.0/25", "Gone", True, True)] + [
    (100 + i, c, c, True, False) for i, c in enumerate(joins.DEFAULT_CIDRS)
]
#: the same rules as the SQL has them, written out
_CIDRS_SQL = [(1, "2.61.0.0/16", "Office"), (2, "172.18.4.0/22", "Lab"), (100, "172.18.0.0/17", "172.18.0.0/17"), (101, "172.28.128.0/19", "172.28.128.0/19"), (102, "2.0.0.0/8", "2.0.0.0/8")]
_RANGES = [("8.8.8.0", "8.8.8.255", "美国|0|0|谷歌|US"), ("211.120.0.0", "211.120.255.255", "中国|江苏|南京|联通|CN"), ("2.0.0.0", "2.255.255.255", "法国|0|0|橙|FR")]
_CIDR_SQL = ", cidrs(rule_order, name, low, high) AS (VALUES " + ", ".join(
    f"({o}, '{n}', {net.number_of(c.split('/')[0])}, {net.number_of(c.split('/')[0]) + 2 ** (32 - int(c.split('/')[1])) - 1})" for o, c, n in _CIDRS_SQL
) + ")"
_RANGE_SQL = ", ranges(ip_from, ip_to, region, province, city, isp) AS (VALUES " + ", ".join(
    f"({net.number_of(a)}, {net.number_of(b)}, {x})" for (a, b, _), x in zip(_RANGES, ["'美国|谷歌', NULL, NULL, '谷歌'", "'中国|江苏|南京|联通', '江苏', '南京', '联通'", "'法国|橙', NULL, NULL, '橙'"])
) + ")"
_IPS = """, ips AS (SELECT DISTINCT ip FROM (SELECT src_ip AS ip FROM ev UNION ALL SELECT dst_ip FROM ev) WHERE ip IS NOT NULL),
  nums AS (SELECT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM ips),
  pub AS (SELECT * FROM nums WHERE NOT (""" + " OR ".join(f"n BETWEEN {net.number_of(a)} AND {net.number_of(b)}" for a, b in net.NOT_PUBLIC) + ")),"
_NAMED = " named AS (SELECT ip, arg_min(name, rule_order) AS name FROM nums JOIN cidrs ON n BETWEEN low AND high GROUP BY 1), found AS (SELECT ip, region, province, city, isp FROM pub JOIN ranges ON n BETWEEN ip_from AND ip_to)"


def _ips(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct()


def cidrs(spark):
    return spark.createDataFrame(_CIDRS, "rule_order int, cidr string, name string, enabled boolean, deleted boolean")


def ranges(spark):
    return spark.createDataFrame([(net.number_of(a), net.number_of(b), r) for a, b, r in _RANGES], "ip_from long, ip_to long, region string")


_GEO = _CIDR_SQL + _RANGE_SQL + _IPS + _NAMED


@register(_GEO + " SELECT ip, name FROM named")
def cidr_region(spark, sf_dir):
    return joins.cidr_names(_ips(events(spark, sf_dir)), cidrs(spark))


@register(_GEO + " SELECT * FROM found")
def ip_range_region(spark, sf_dir):
    return joins.range_regions(_ips(events(spark, sf_dir)), ranges(spark))


@register(_GEO + ", reg AS (SELECT ip, coalesce(name, region) AS region FROM named FULL JOIN found USING (ip)) SELECT event_id, s.region AS src_region, d.region AS dst_region, coalesce(s.region, d.region) AS geo_region FROM ev LEFT JOIN reg s ON src_ip = s.ip LEFT JOIN reg d ON dst_ip = d.ip")
def enrich_geo(spark, sf_dir):
    return joins.with_regions(kept_events(spark, sf_dir, "event_id", "src_ip", "dst_ip"), cidrs(spark), ranges(spark)).select("event_id", "src_region", "dst_region", "geo_region")


@register(_GEO + " SELECT ip FROM pub WHERE ip NOT IN (SELECT ip FROM named)")
def pending_public_ips(spark, sf_dir):
    ips = tables.kept(_ips(events(spark, sf_dir)), "addresses")
    return joins.pending_ips(ips, joins.cidr_names(ips, cidrs(spark)))


# ---------------------------------------------------------------- tiers


#: events from the first day on are hot; those before the last are frozen, others in Parquet
_HOT, _COLD = datetime(2024, 1, 20), datetime(2024, 1, 10)
_TIERS_SQL = """, t AS (SELECT *, CASE WHEN ingest_time >= TIMESTAMP '2024-01-20 00:00:00' THEN 0 WHEN ingest_time >= TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 2 END AS tier_rank,
      CASE WHEN ingest_time < TIMESTAMP '2024-01-20 00:00:00' AND ingest_time >= TIMESTAMP '2024-01-10 00:00:00' THEN concat('events-', strftime(ingest_time, '%Y%m%d'), '.parquet') END AS archive_path FROM ev)"""
_TIERED_SQL = f" SELECT {EVENT}, CASE tier_rank WHEN 0 THEN 'hot' WHEN 1 THEN 'parquet' ELSE 'frozen' END AS result_source, archive_path FROM t WHERE {_OK}"
_TIER_ORDER = " ORDER BY tier_rank, t.archive_path NULLS FIRST, t.ingest_time DESC, t.event_id DESC LIMIT "


def _tiers(spark, sf_dir):
    """All events, each in the tier that its ingest day puts it in."""
    rows, at = events(spark, sf_dir), F.col("ingest_time")
    path = F.concat(F.lit("events-"), F.date_format(at, "yyyyMMdd"), F.lit(".parquet"))
    return rows.where(at >= F.lit(_HOT)), rows.where((at < F.lit(_HOT)) & (at >= F.lit(_COLD))).withColumn("path", path), rows.where(at < F.lit(_COLD))


@register(_TIERS_SQL + _TIERED_SQL + " AND source_addr LIKE '%10.0.0.%'" + _TIER_ORDER + "3000")
def tier_search(spark, sf_dir):
    return shown(search.tiered(Search(device="10.0.0.", limit=3000), *_tiers(spark, sf_dir)))


@register(" SELECT source_addr, src_ip, dst_ip, CAST('' AS VARCHAR) AS raw, parse_status, count(*) AS n, count(*) AS ids FROM ev WHERE parse_status <> 'failed' GROUP BY ALL")
def tier_search_schema_adapt(spark, sf_dir):
    """Every event in the slim layout, searched: each row gets an id of its own."""
    rows = search.adapted(search.slim(events(spark, sf_dir)), F.lit("events.parquet"))
    keys = ["source_addr", "src_ip", "dst_ip", "raw", "parse_status"]
    return search.matching(rows, Search()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@register(
    f""", t AS (SELECT 0 AS tier_rank, * FROM ev WHERE ingest_time >= TIMESTAMP '2024-01-10 00:00:00' UNION ALL SELECT 1, * FROM ev WHERE ingest_time < TIMESTAMP '2024-01-20 00:00:00'),
    f AS (SELECT event_id, tier_rank, min(tier_rank) OVER (PARTITION BY event_id) AS lowest FROM t WHERE {_OK})
    SELECT event_id, tier_rank, count(*) AS n FROM f WHERE tier_rank = lowest GROUP BY 1, 2"""
)
def tier_search_dedup(spark, sf_dir):
    """Tiers that share the days between their bounds: what is in both comes from the hot one."""
    rows, at = events(spark, sf_dir), F.col("ingest_time")
    found = search.tier_rows(Search(), rows.where(at >= F.lit(_COLD)), rows.where(at < F.lit(_HOT)), dedup=True)
    return found.groupBy("event_id", "tier_rank").agg(F.count("*").alias("n"))


def _stored(spark, sf_dir):
    """The events of all lines as a table by day, which later searches read."""
    path = tables.scratch(spark, "events")
    tables.store(events(spark, sf_dir), path)
    return tables.stored(spark, path)


@register(f""" SELECT {EVENT} FROM ev WHERE {_OK} AND coalesce(event_time, ingest_time) >= TIMESTAMP '2024-01-12 00:00:00' AND coalesce(event_time, ingest_time) < TIMESTAMP '2024-01-15 00:00:00'
    AND protocol = 'TCP' AND lower(action) = 'allow'""" + _NEW + "2000")
def stored_search(spark, sf_dir):
    """A search of days and fields on a stored table, whose days' bounds leave a few."""
    what = Search(date_from="2024-01-12", date_to="2024-01-14", protocol="tcp", action="Allow", limit=2000)
    path = tables.scratch(spark, "events")
    tables.store(events(spark, sf_dir), path)
    tables.write_bounds(spark, path)
    return shown(search.search_hot(tables.bounded(spark, path, what.date_from, what.date_to), what).select(EVENT_COLUMNS))


@register(f" SELECT event_id, {TIME('ingest_time')} AS ingest_time, source_addr, parse_status FROM ev WHERE ingest_time BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-07 06:00:00'")
def stored_history(spark, sf_dir):
    """A history query of a stored table, of whose days three are read."""
    found = search.within(_stored(spark, sf_dir), datetime(2024, 1, 5, 12), datetime(2024, 1, 7, 6))
    return shown(found.select("event_id", "ingest_time", "source_addr", "parse_status"))


@register(
    f""" SELECT CAST(CAST(ingest_time AS DATE) AS VARCHAR) AS bucket_day, {TIME("date_trunc('hour', ingest_time)")} AS bucket, source_addr, count(*) AS total_count,
      CAST(sum(strlen(raw)) AS BIGINT) AS raw_bytes, {TIME('max(ingest_time)')} AS last_seen
    FROM (SELECT DISTINCT event_id, ingest_time, source_addr, raw FROM ev) GROUP BY ALL"""
)
def stream_history(spark, sf_dir):
    """All lines as a stream of files, parsed, stored once and added up on insert; the view
    by source and hour."""
    path = tables.scratch(spark, "stream")
    lines(spark, sf_dir).select("ingest_time", "source_addr", "raw").write.parquet(f"{path}/lines")
    found = parse.parse_events(spark.readStream.schema(RAW).parquet(f"{path}/lines"), rules=[ARROW])
    writer = found.writeStream.foreachBatch(stream.history_batch(f"{path}/history", f"{path}/views"))
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shown(stream.stored_view(spark, f"{path}/views", "source"))


# ---------------------------------------------------------------- learning

_CAND = """, cand AS (SELECT concat('rule:', scope_key, ':actName:action') AS rule_id, scope_key, 'actName' AS raw_key, 'action' AS canonical_field, 'action' AS value_type, line_id, event_id
  FROM ev WHERE shape = 4 AND source_addr LIKE '%://%'),
  st AS (SELECT rule_id, scope_key, raw_key, canonical_field, value_type, count(*) AS n FROM cand GROUP BY ALL),
  rated AS (SELECT *, greatest(0.0, least(1.0, (1.0 + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt((1.96 * 1.96 / (4.0 * n)) / n)) / (1.0 + 1.96 * 1.96 / n))) AS bound FROM st)
"""


def _state(spark, sf_dir, min_samples=20, bound=0.8, found=None):
    empty = spark.createDataFrame([], RULE)
    rows = learn.observed(empty, learn.candidates(events(spark, sf_dir) if found is None else found))
    return learn.activated(rows, min_samples, bound)


@register(_CAND + " SELECT rule_id, scope_key, raw_key, canonical_field, value_type, n FROM st")
def learn_candidates(spark, sf_dir):
    keys = ["rule_id", "scope_key", "raw_key", "canonical_field", "value_type"]
    return learn.candidates(events(spark, sf_dir)).groupBy(*keys).agg(F.count("*").alias("n"))


@register(_CAND + " SELECT rule_id, n AS sample_count, n AS wins, round(bound, 4) AS confidence FROM rated")
def learn_wilson(spark, sf_dir):
    return _state(spark, sf_dir).select("rule_id", "sample_count", "wins", F.round("confidence", 4).alias("confidence"))


@register(_CAND + " SELECT rule_id, CASE WHEN n >= 20 AND bound >= 0.8 THEN 'active' ELSE 'shadow' END AS status FROM rated")
def learn_activate(spark, sf_dir):
    return _state(spark, sf_dir).select("rule_id", "status")


@register(
    _CAND + """ SELECT ev.event_id, CASE WHEN a.line_id IS NOT NULL THEN regexp_extract(raw, 'actName=([^ ]+)', 1) ELSE action END AS action,
      CASE WHEN a.line_id IS NOT NULL THEN 'parsed' ELSE parse_status END AS parse_status
    FROM ev LEFT JOIN (SELECT line_id FROM cand JOIN rated USING (rule_id) WHERE n >= 20 AND bound >= 0.8) a USING (line_id)"""
)
def learn_apply(spark, sf_dir):
    rows = kept_events(spark, sf_dir, *_LEARNED)
    rules = learn.active_rules(_state(spark, sf_dir, found=rows))
    return parse.apply_learned(rows, rules).select("event_id", "action", "parse_status")


@register(
    _CAND + """, wrong AS (SELECT scope_key, count(*) FILTER (shape = 5) AS n FROM ev WHERE source_addr LIKE '%://%' GROUP BY 1)
    SELECT rule_id, CASE WHEN n >= 20 AND bound >= 0.8 THEN 'active' ELSE 'shadow' END AS status, CAST(NULL AS VARCHAR) AS disabled_reason FROM rated
    UNION ALL SELECT concat('rule:', scope_key, ':proto:dst_ip'), CASE WHEN n >= 50 THEN 'disabled' ELSE 'active' END,
      CASE WHEN n >= 50 THEN 'rollback: active rule value conversion conflict threshold exceeded' END FROM wrong"""
)
def learn_rollback(spark, sf_dir):
    """The learned rules, which hold, and for each source one that takes protocols for
    addresses: every line that it meets is a conflict."""
    rows = kept_events(spark, sf_dir, *_LEARNED)
    learned = _state(spark, sf_dir, found=rows)
    wrong = rows.where("source_addr like '%://%'").select("scope_key").distinct().select(
        F.concat(F.lit("rule:"), "scope_key", F.lit(":proto:dst_ip")).alias("rule_id"), "scope_key", F.lit("proto").alias("raw_key"), F.lit("dst_ip").alias("canonical_field"),
        F.lit("ip").alias("value_type"), F.lit("active").alias("status"), F.lit(0.9).alias("confidence"), F.lit(0).cast("long").alias("wins"),
        F.lit(0).cast("long").alias("sample_count"), F.lit(None).cast("string").alias("disabled_reason"),
    )
    state = tables.kept(learned.unionByName(wrong), "rules")
    counters = learn.attributed(parse.apply_learned(rows, learn.active_rules(state)))
    return learn.rolled_back(state, counters).select("rule_id", "status", "disabled_reason")


@register(_CAND + " SELECT rule_id, n AS total, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS conflicts FROM rated WHERE n >= 20 AND bound >= 0.8")
def learn_loop(spark, sf_dir):
    """The whole learning loop over versioned state: all events teach the rules, then come
    as a second batch that the active rules fill; what the rules did there."""
    root, rows = tables.scratch(spark, "learned"), _stored(spark, sf_dir)
    run = stream.learn_batch(root, min_samples=20, bound=0.8)
    for number in (0, 1, 1):  # the last comes again and counts once
        run(rows, number)
    return sinks.state(spark, root, "counters").select("rule_id", "total", "failed", "conflicts")


@register(_CAND + " SELECT count(*) FILTER (n >= 20 AND bound >= 0.8) AS active, count(*) FILTER (NOT (n >= 20 AND bound >= 0.8)) AS shadow, CAST(0 AS BIGINT) AS disabled FROM rated")
def learn_status_counts(spark, sf_dir):
    return learn.status_counts(_state(spark, sf_dir))


@register(f" SELECT scope_key AS source_key, source_addr AS raw_source, device_id, {TIME('min(ingest_time)')} AS first_seen, {TIME('max(ingest_time)')} AS last_seen, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def source_aliases(spark, sf_dir):
    return shown(learn.source_aliases(events(spark, sf_dir)))


_SHAPED = f""", failed AS (SELECT *, sha256(concat_ws(chr(31), scope_key, regexp_extract(parse_error, '^([^\\[]*)', 1),
    concat_ws(',', CASE WHEN src_ip IS NULL THEN 'src_ip' END, CASE WHEN dst_ip IS NULL THEN 'dst_ip' END, CASE WHEN protocol IS NULL THEN 'protocol' END, CASE WHEN action IS NULL THEN 'action' END),
    array_to_string(list_sort(regexp_extract_all(raw, '{_PAIR}', 1)[1:64]), ','),
    regexp_replace(regexp_replace(raw, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'a', 'g'))) AS fingerprint FROM ev WHERE parse_status = 'failed')"""


@register(_SHAPED + f" SELECT scope_key, fingerprint, min(parse_error) AS reason, min(raw) AS sample, count(*) AS n, {TIME('max(ingest_time)')} AS last_seen FROM failed GROUP BY 1, 2")
def failure_fingerprints(spark, sf_dir):
    return shown(learn.failure_fingerprints(events(spark, sf_dir)))


@register(
    _SHAPED + f""" SELECT scope_key, {TIME('minute')} AS minute, shapes, sources, shapes > 200 OR sources > 200 AS held,
      CASE WHEN shapes > 200 OR sources > 200 THEN {TIME("minute + INTERVAL 300 SECOND")} END AS until
    FROM (SELECT scope_key, date_trunc('minute', ingest_time) AS minute, count(DISTINCT fingerprint) AS shapes, count(DISTINCT source_addr) AS sources FROM failed GROUP BY 1, 2)"""
)
def flood_guard(spark, sf_dir):
    return shown(learn.flood_counts(events(spark, sf_dir)))


# ---------------------------------------------------------------- views and stores


@register(f" SELECT {EVENT} FROM ev WHERE ingest_time >= TIMESTAMP '2024-01-05 06:00:00' AND ingest_time <= TIMESTAMP '2024-01-07 18:30:00'")
def history_bounds(spark, sf_dir):
    return shown(search.within(events(spark, sf_dir), datetime(2024, 1, 5, 6), datetime(2024, 1, 7, 18, 30)).select(EVENT_COLUMNS))


@register(f" SELECT event_id, {TIME('coalesce(event_time, ingest_time)')} AS time, parse_status, regexp_replace(source_addr, '^[a-z]+://', '') AS device, raw FROM ev{_NEW}40")
def recent_stream(spark, sf_dir):
    return shown(search.recent_stream(events(spark, sf_dir)))


@register(f" SELECT event_id, {TIME('ingest_time')} AS ingest_time FROM ev WHERE ingest_time > TIMESTAMP '2024-01-12 00:00:00' ORDER BY ev.ingest_time, event_id LIMIT 1500")
def sync_batch(spark, sf_dir):
    return shown(search.oldest(events(spark, sf_dir), datetime(2024, 1, 12), 1500).select("event_id", "ingest_time"))


@register(_DEVICE_SQL + " SELECT event_id, coalesce(d.id, device_id) AS device_id, coalesce(n.name, d.id, device_id, ev.source_addr) AS device_label FROM ev LEFT JOIN devices d ON d.enabled AND ev.source_addr = lower(d.protocol) || '://' || d.host || ':' || CAST(d.port AS VARCHAR) LEFT JOIN devices n ON n.id = coalesce(d.id, device_id)")
def device_labels(spark, sf_dir):
    rows = joins.backfill_devices(events(spark, sf_dir), devices(spark))
    return joins.device_names(rows, devices(spark)).select("event_id", "device_id", "device_label")


def _daily_files(rows: DataFrame) -> DataFrame:
    """One archive for each day of the events: even days as Parquet, odd days frozen."""
    even = F.dayofmonth("day") % 2 == 0
    days = rows.groupBy(F.to_date("ingest_time").alias("day")).agg(F.sum(F.octet_length("raw")).alias("bytes"))
    digits = F.date_format("day", "yyyyMMdd")
    path = F.when(even, F.concat(F.lit("/archive/events-"), digits, F.lit(".parquet"))).otherwise(F.concat(F.lit("/archive/raw-"), digits, F.lit(".raw.zst")))
    return days.select(path.alias("path"), "bytes", F.when(even, "parquet").otherwise("frozen").alias("category"), F.when(even, F.col("day").cast("string")).otherwise("unknown").alias("day"))


@register(" SELECT DISTINCT CAST(CAST(ingest_time AS DATE) AS VARCHAR) AS day FROM ev")
def archive_days(spark, sf_dir):
    files = tables.kept(_daily_files(events(spark, sf_dir)), "files")
    return metrics.archive_days(files.select("day"), files.where("category = 'frozen'"))


@register(
    """, f AS (SELECT CAST(ingest_time AS DATE) AS day, sum(strlen(raw)) AS bytes FROM ev GROUP BY 1)
    SELECT CASE WHEN day(day) % 2 = 0 THEN 'parquet' ELSE 'frozen' END AS tier, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS rows FROM f GROUP BY 1
    UNION ALL SELECT 'hot', NULL, NULL, count(*) FILTER (ingest_time >= TIMESTAMP '2024-01-20 00:00:00') FROM ev
    UNION ALL SELECT 'history', NULL, NULL, count(*) FROM ev"""
)
def storage_stats(spark, sf_dir):
    rows = kept_events(spark, sf_dir, "ingest_time", "raw")
    return metrics.storage_stats(_daily_files(rows), search.within(rows, datetime(2024, 1, 20), datetime(9999, 1, 1)), rows)


@register(
    """, there AS (SELECT *, ingest_time < TIMESTAMP '2024-01-10 00:00:00' AS old FROM ev)
    SELECT count(*) AS received, count(*) FILTER (NOT old) AS stored, count(*) FILTER (old) AS replayed, count(*) FILTER (NOT old AND parse_status = 'parsed') AS parsed FROM there"""
)
def batch_counters(spark, sf_dir):
    rows = kept_events(spark, sf_dir, "event_id", "ingest_time", "parse_status")
    return metrics.batch_counters(rows, rows.where(F.col("ingest_time") < F.lit(datetime(2024, 1, 10))))


@register(ROLLUP + f" SELECT {TIME('bucket_minute')} AS bucket_minute, source_addr, protocol, action, parse_status, total_count FROM rollup WHERE CAST(bucket_minute AS DATE) >= DATE '2024-02-10' - 30")
def history_ttl(spark, sf_dir):
    from siftline.operators.lifecycle import ROLLUP_DAYS, living

    rows = living(rollup(spark, sf_dir), datetime(2024, 2, 10, 12), ROLLUP_DAYS, "bucket_minute")
    return shown(rows.drop("raw_bytes"))


@register(_CAND + " SELECT rule_id, scope_key, raw_key, canonical_field, value_type FROM st")
def learn_state_listing(spark, sf_dir):
    return learn.state_listing(_state(spark, sf_dir)).select("rule_id", "scope_key", "raw_key", "canonical_field", "value_type")


@register(_TIERS_SQL + _TIERED_SQL + _TIER_ORDER + "100000")
def search_collect(spark, sf_dir):
    """All events, in the tier that their day puts them in."""
    return shown(search.tiered(Search(limit=search.QUERY_LIMIT), *_tiers(spark, sf_dir)))
