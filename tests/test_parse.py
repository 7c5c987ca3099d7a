import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.operators import learn, parse
from siftline.schema import RULE

T0 = dt.datetime(2026, 5, 15, 1, 20)
LINES = {
    "nat": "Apr 11 07:41:33 localhost nat: 日志类型:NAT日志, NAT类型:snat, 源IP:2.61.17.9, 源端口:40117, 目的IP:211.120.5.31, 目的端口:6881, 协议:17",
    "zh": "源IP:192.168.1.10, 目的IP:8.8.8.8, 源端口:12345, 目的端口:53, 协议:17, NAT类型:snat",
    "ips": "192.168.1.1 connected to 10.0.0.1 on port 443 action=block",
    "quoted": "src=\"192.168.1.1\" dst='10.0.0.1' action=\"deny\" proto=\"udp\"",
    "six": "src=1.1.1.1 dst=2.2.2.2 action=allow proto=6",
    "partial": "src=10.0.0.1 proto=TCP",
    "arrow": "2024-01-15T10:00:00Z my-device [firewall] 172.16.0.1 -> 192.168.0.1 DROP",
    "none": "this is just random text without any structure",
    "empty": "",
}
ARROW = parse.ParseRule(
    "ArrowLine", 10, r"^\S+ (?P<dev>\S+) \[firewall\] (?P<src>[0-9.]+) -> (?P<dst>[0-9.]+) (?P<act>\w+)",
    [("device_id", "dev", None), ("src_ip", "src", None), ("dst_ip", "dst", None), ("action", "4", "uppercase")],
)


def raw(spark, lines, source="udp://192.168.1.10:514"):
    rows = [(T0, source, x, k) for k, x in lines.items()]
    return spark.createDataFrame(rows, "ingest_time timestamp, source_addr string, raw string, k string")


@pytest.fixture(scope="module")
def parsed(spark):
    rows = parse.parse_events(raw(spark, LINES), rules=[ARROW], diagnostics=True).collect()
    return {r["k"]: r for r in rows}


def test_vendor_line(parsed):
    r = parsed["nat"]
    assert (r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol, r.action) == ("2.61.17.9", 40117, "211.120.5.31", 6881, "UDP", "snat")
    assert (r.vendor, r.parse_status, r.parse_error) == ("Sangfor", "parsed", None)
    assert r.event_time == dt.datetime(2026, 4, 11, 7, 41, 33)


def test_generic_lines(parsed):
    assert (parsed["zh"].protocol, parsed["zh"].action, parsed["zh"].parse_status) == ("UDP", "snat", "parsed")
    assert (parsed["ips"].src_ip, parsed["ips"].dst_ip, parsed["ips"].action) == ("192.168.1.1", "10.0.0.1", "block")
    assert (parsed["quoted"].src_ip, parsed["quoted"].dst_ip, parsed["quoted"].action, parsed["quoted"].protocol) == ("192.168.1.1", "10.0.0.1", "deny", "UDP")
    assert parsed["six"].protocol == "TCP"


def test_partial_failed_and_rules(parsed):
    assert parsed["partial"].parse_status == "partial" and "minimum searchable tuple" in parsed["partial"].parse_error
    assert (parsed["arrow"].device_id, parsed["arrow"].vendor, parsed["arrow"].action) == ("my-device", "ArrowLine", "DROP")
    assert parsed["none"].parse_status == "failed" and parsed["none"].parse_error.startswith("no parser matched; attempted [")
    assert parsed["empty"].parse_status == "failed"
    assert [a.name for a in parsed["none"].attempts] == ["RuleBased", "SangforAdapter"]


def test_rule_priority_and_checks(spark):
    rules = [parse.ParseRule("Low", 99, "action=(\\w+)", [("action", "1", None)]), parse.ParseRule("High", 1, "action=(\\w+)", [("action", "1", "uppercase")])]
    rows = parse.rule_columns(raw(spark, {"a": "action=block"}), rules).select("rules_result.*").first()
    assert (rows.vendor, rows.action) == ("High", "BLOCK")
    with pytest.raises(ValueError, match="duplicate"):
        parse.checked_rules([rules[0], rules[0]])
    with pytest.raises(ValueError, match="invalid"):
        parse.checked_rules([parse.ParseRule("x", 1, "(", [])])


def test_scopes_and_pairs(spark):
    df = spark.createDataFrame([("udp://192.168.1.10:55123",), ("not a uri",), ("tcp://[fe80::1]:514",)], "s string")
    one, with_port = (df.select(parse.source_scope(F.col("s"), p)[0].alias("k")).collect() for p in (False, True))
    assert [r.k for r in one] == ["source:udp://192.168.1.10", one[1].k, "source:tcp://fe80::1"] and len(one[1].k) == len("source:unknown:") + 8
    assert with_port[0].k == "source:udp://192.168.1.10:55123"
    k, v, cut, long = parse.pairs(F.lit("src=192.168.1.1 dst:10.0.0.1 action=allow"), most=2)
    row = spark.range(1).select(k.alias("k"), v.alias("v"), cut.alias("c"), long.alias("l")).first()
    assert (row.k, row.v, row.c, row.l) == (["src", "dst"], ["192.168.1.1", "10.0.0.1"], True, False)


def test_pins_and_adapters(spark):
    pins = spark.createDataFrame([("source:udp://192.168.1.10", ["parser:generic_kv_v1"])], "scope_key string, parser_ids array<string>")
    line = {"a": "Sangfor: src=1.1.1.1 dst=2.2.2.2 proto=6 action=allow"}
    assert parse.parse_events(raw(spark, line)).first().vendor == "Sangfor"
    assert parse.parse_events(raw(spark, line), pins=pins).first().vendor is None
    mine = parse.Adapter("parser:mine", "Mine", lambda r: r.startswith("mine"), lambda r: parse.result({"src_ip": F.lit("9.9.9.9"), "dst_ip": F.lit("8.8.8.8"), "action": F.lit("x")}))
    assert parse.parse_events(raw(spark, {"a": "mine"}), adapters=[mine]).first().src_ip == "9.9.9.9"


def test_learning_loop(spark):
    events = parse.parse_events(raw(spark, {str(i): "src=10.0.0.1 dst=10.0.0.2 actName=allow" for i in range(4)}))
    found = learn.candidates(events)
    state = learn.activated(learn.observed(spark.createDataFrame([], RULE), found), 2, 0.2)
    rules = learn.active_rules(state)
    assert [(r.raw_key, r.canonical_field, r.wins) for r in rules.collect()] == [("actName", "action", 4)]
    applied = parse.apply_learned(events, rules)
    assert {(r.action, r.parse_status) for r in applied.collect()} == {("allow", "parsed")}
    assert learn.activated(state.withColumn("status", F.lit("shadow")), 2, 0.2, auto=False).first().status == "shadow"
    none = parse.parse_events(raw(spark, {k: f"src=10.0.0.1 {k}=x" for k in ("activation", "transaction", "gradeName", "target")}))
    assert learn.candidates(none).count() == 0


def test_rollback(spark):
    events = parse.parse_events(raw(spark, {str(i): "peer=somewhere" for i in range(60)}))
    rule = [("rule:x", "source:udp://192.168.1.10", "peer", "dst_ip", "ip", "active", 1.0, 1, 1, None)]
    state = spark.createDataFrame(rule, RULE)
    counters = learn.attributed(parse.apply_learned(events, state))
    assert tuple(counters.first()) == ("rule:x", 60, 60, 60)
    assert learn.rolled_back(state, counters).first().status == "disabled"
