"""Registered queries on rules, pins, shadow samples, imports, replacement and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import net
from siftline.operators import learn, parse
from siftline.plans.lines import ARROW, lines
from siftline.plans.oracle import ROLLUP, TIME, protocol, q
from siftline.plans.queries import _stored, register, shown
from siftline.schema import EVENT_COLUMNS, RULE
from siftline.sources import files, rollups, tables

# ---------------------------------------------------------------- rules, pins

#: tried by priority, not in this order
RULES = [
    parse.ParseRule("AnyAction", 20, r"act(?:ion|Name)=(\w+)", [("action", "1", "uppercase")]),
    parse.ParseRule("Chinese", 30, r"NAT类型:([a-z]+), 源IP:([0-9.]+)", [("action", "1", "lowercase"), ("src_ip", "2", None)]),
    parse.ParseRule("Tuple", 10, r"src=(?P<s>[0-9.]+) dst=(?P<d>[0-9.]+) .*proto=(?P<p>\w+)", [("src_ip", "s", None), ("dst_ip", "d", None), ("protocol", "p", "normalize_protocol")]),
]
_TUPLE, _ANY, _CHINESE = r"src=([0-9.]+) dst=([0-9.]+) .*proto=(\w+)", r"act(?:ion|Name)=(\w+)", r"NAT类型:([a-z]+), 源IP:([0-9.]+)"


@register(
    f""", hit AS (SELECT line_id, raw, CASE WHEN regexp_matches(raw, {q(_TUPLE)}) THEN 'Tuple' WHEN regexp_matches(raw, {q(_ANY)}) THEN 'AnyAction' WHEN regexp_matches(raw, {q(_CHINESE)}) THEN 'Chinese' END AS vendor FROM lines),
    got AS (SELECT line_id, vendor,
      CASE vendor WHEN 'Tuple' THEN regexp_extract(raw, {q(_TUPLE)}, 1) WHEN 'Chinese' THEN regexp_extract(raw, {q(_CHINESE)}, 2) END AS src_ip,
      CASE vendor WHEN 'Tuple' THEN regexp_extract(raw, {q(_TUPLE)}, 2) END AS dst_ip,
      CASE vendor WHEN 'Tuple' THEN {protocol(f"regexp_extract(raw, {q(_TUPLE)}, 3)")} END AS protocol,
      CASE vendor WHEN 'AnyAction' THEN upper(regexp_extract(raw, {q(_ANY)}, 1)) WHEN 'Chinese' THEN lower(regexp_extract(raw, {q(_CHINESE)}, 1)) END AS action FROM hit)
    SELECT *, CASE vendor WHEN 'Tuple' THEN 'parsed' WHEN 'AnyAction' THEN 'partial' WHEN 'Chinese' THEN 'partial' ELSE 'failed' END AS parse_status,
      CASE WHEN vendor IS NULL THEN 'rule-based parser: no rule matched' WHEN vendor <> 'Tuple' THEN 'partial parse: minimum searchable tuple incomplete' END AS parse_error FROM got"""
)
def rule_transforms(spark, sf_dir):
    """Three rules by priority, with captures by name and number and every transform."""
    names = ["vendor", "src_ip", "dst_ip", "protocol", "action", "parse_status", "parse_error"]
    return parse.rule_columns(lines(spark, sf_dir), RULES).select("line_id", *(F.col(f"rules_result.{n}").alias(n) for n in names))


_TRY = "CASE c WHEN 'V' THEN CASE WHEN detected THEN v_status END WHEN 'G' THEN CASE WHEN gated THEN g_status END WHEN 'R' THEN r_status WHEN 'W' THEN CASE WHEN NOT detected THEN v_status END END"


@register(
    f""", route AS (SELECT *, CASE WHEN source_addr LIKE '%10.0.0.3:%' THEN ['G', 'V', 'R', 'W'] WHEN source_addr LIKE '%10.0.0.4:%' THEN ['R', 'G', 'V', 'W'] ELSE ['V', 'G', 'R', 'W'] END AS ord FROM try),
    flat AS (SELECT *, unnest(ord) AS c, unnest(range(4)) AS pos FROM route),
    tried AS (SELECT *, {_TRY} AS s FROM flat),
    best AS (SELECT line_id, min_by(c, pos + CASE s WHEN 'parsed' THEN 0 ELSE 10 END) AS c FROM tried WHERE s IN ('parsed', 'partial') GROUP BY 1)
    SELECT line_id, CASE c WHEN 'V' THEN v_status WHEN 'W' THEN v_status WHEN 'G' THEN g_status WHEN 'R' THEN r_status ELSE 'failed' END AS parse_status,
      CASE c WHEN 'V' THEN 'parser:sangfor_nat_v1' WHEN 'W' THEN 'parser:sangfor_nat_v1' WHEN 'G' THEN 'parser:generic_kv_v1' WHEN 'R' THEN 'parser:rule_based_v1' END AS matched_parser
    FROM try LEFT JOIN best USING (line_id)"""
)
def pinned_parsers(spark, sf_dir):
    """Two hosts' scopes with parsers pinned before the usual order."""
    rows = lines(spark, sf_dir)
    scopes = rows.select(parse.source_scope(F.col("source_addr"))[0].alias("scope_key")).distinct()
    first = F.when(F.col("scope_key").endswith("10.0.0.3"), F.array(F.lit(parse.GENERIC_ID))).when(F.col("scope_key").endswith("10.0.0.4"), F.array(F.lit(parse.RULES_ID), F.lit(parse.GENERIC_ID)))
    pins = scopes.withColumn("parser_ids", first).where("parser_ids is not null")
    return parse.parse_events(rows, rules=[ARROW], pins=pins, diagnostics=True).select("line_id", "parse_status", "matched_parser")


# ---------------------------------------------------------------- shadow samples


@register(
    """, sample AS (SELECT concat('rule:source:', regexp_replace(source_addr, ':[0-9]+$', ''), ':target_ip:dst_ip') AS rule_id, CASE WHEN line_id % 3 = 0 THEN 0 ELSE 1 END AS won FROM lines WHERE shape = 5),
    st AS (SELECT rule_id, count(*) AS sample_count, CAST(sum(won) AS BIGINT) AS wins, sum(won) / count(*) AS p FROM sample GROUP BY 1),
    rated AS (SELECT *, greatest(0.0, least(1.0, (p + 1.96 * 1.96 / (2.0 * sample_count) - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4.0 * sample_count)) / sample_count)) / (1 + 1.96 * 1.96 / sample_count))) AS bound FROM st)
    SELECT rule_id, sample_count, wins, round(bound, 4) AS confidence, CASE WHEN sample_count >= 20 AND bound >= 0.6 THEN 'active' ELSE 'shadow' END AS status FROM rated"""
)
def learn_shadow(spark, sf_dir):
    """Samples that are won and lost: of a third of the lines the key's first value, which a
    rule would take, is no address, so applying it conflicts."""
    bad = F.when(F.col("line_id") % 3 == 0, " target_ip=unknown").otherwise("")
    rows = lines(spark, sf_dir).where("shape = 5").withColumn("raw", F.concat("raw", bad, F.lit(" target_ip=fe80::1")))
    found = learn.candidates(parse.parse_events(rows, rules=[ARROW]))
    state = learn.activated(learn.observed(spark.createDataFrame([], RULE), found), 20, 0.6)
    return state.select("rule_id", "sample_count", "wins", F.round("confidence", 4).alias("confidence"), "status")


# ---------------------------------------------------------------- imports, replacement


@register(ROLLUP + f" SELECT {TIME('bucket_minute')} AS bucket_minute, source_addr, protocol, action, parse_status, total_count, raw_bytes FROM rollup")
def csv_import(spark, sf_dir):
    """CSV files of the parsed and partial events, then of all: what is stored already is
    left out, and the rollup counts every event once."""
    path, rows = tables.scratch(spark, "csv"), _stored(spark, sf_dir).select(EVENT_COLUMNS)
    kept = rollups.Rollups(spark, f"{path}/rollup")
    for name, part in (("some", rows.where("parse_status <> 'failed'")), ("all", rows)):
        part.write.option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(f"{path}/{name}")
        rollups.import_csv(spark, f"{path}/{name}", f"{path}/hot", kept, name)
    return shown(kept.rows())


@register(" SELECT event_id, vendor, src_ip, dst_ip, action, parse_status FROM ev")
def reparse_replace(spark, sf_dir):
    """Events stored before there was a rule, parsed again with it under their ids; the new
    table takes the old one's place and the rollup is built anew."""
    path = tables.scratch(spark, "reparse")
    kept, hot = rollups.Rollups(spark, f"{path}/rollup"), f"{path}/hot"
    n = rollups.insert_with_rollup(parse.parse_events(lines(spark, sf_dir)).select(EVENT_COLUMNS), hot, kept, "first")
    again = files.reparsed(spark.read.parquet(hot), rules=[ARROW]).select(EVENT_COLUMNS)
    rollups.replace_with_rollup(again, hot, kept, n)
    return spark.read.parquet(hot).select("event_id", "vendor", "src_ip", "dst_ip", "action", "parse_status")


# ---------------------------------------------------------------- scalar functions


@register(
    f""", t AS (SELECT line_id, event_id, ingest_time, line_id * 1000003 AS n,
      CASE line_id % 4 WHEN 0 THEN '中国|0|北京|0' WHEN 1 THEN 'Germany|0|0|0' WHEN 2 THEN 'my LAN' END AS region FROM ev)
    SELECT line_id, substr(event_id, 1, 12) AS short,
      CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{{:.1f}} KB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN format('{{:.1f}} MB', round(n / 1048576.0, 1)) ELSE format('{{:.1f}} GB', round(n / 1073741824.0, 1)) END AS size,
      CASE WHEN line_id % 3 < 2 THEN CAST(CAST(ingest_time AS DATE) AS VARCHAR) END AS day,
      CASE line_id % 4 WHEN 0 THEN {TIME("date_trunc('day', ingest_time)")} WHEN 3 THEN NULL ELSE {TIME("date_trunc('second', ingest_time)")} END AS at,
      line_id % 4 = 1 AS abroad FROM t"""
)
def scalar_texts(spark, sf_dir):
    """Sizes, short hashes, days and times from texts of several forms, regions abroad."""
    rows, style = lines(spark, sf_dir), F.col("line_id") % 4
    written = lambda form: F.date_format("ingest_time", form)
    day = F.when(F.col("line_id") % 3 == 0, written("yyyy-MM-dd")).when(F.col("line_id") % 3 == 1, written("yyyyMMdd")).otherwise(written("dd/MM"))
    at = F.when(style == 0, written("yyyy-MM-dd")).when(style == 1, written("yyyy-MM-dd HH:mm:ss")).when(style == 2, written("yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise("soon")
    region = F.when(style == 0, "中国|0|北京|0").when(style == 1, "Germany|0|0|0").when(style == 2, "my LAN")
    return shown(
        rows.select(
            "line_id", net.short_hash(parse.event_id(F.col("raw"), F.col("ingest_time"), F.col("source_addr"))).alias("short"),
            net.byte_size(F.col("line_id") * 1000003).alias("size"), net.day_of(day).alias("day"), net.flexible_time(at).alias("at"),
            F.coalesce(net.is_foreign(region), F.lit(False)).alias("abroad"),
        )
    )
