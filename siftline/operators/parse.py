"""Raw lines to canonical events, as columns: vendor, generic key/value and rule parsers,
and the engine that tries them in order.

Every parser is a struct column with the same fields; the engine keeps the attempts in an
array, takes the first that is parsed, else the first that is partial, else reports why
all failed. Nothing is shuffled. A line's pairs are cut and named by Arrow's kernels, a batch
at a time: as lambdas of Spark's they took most of the time.
"""

from __future__ import annotations

import re
import tomllib
from functools import cache
from dataclasses import dataclass, field

import pyarrow as pa  # noqa: F401  of the Arrow function's annotations
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.net import is_ip, protocol_name, small, u16

#: white space as Unicode has it where these lines do: the patterns' class, and its characters
WS = r"\s\x{3000}\x{a0}"
BLANKS = " \t\n\x0b\f\r\u3000\u00a0"
#: fixed values: keys of the vendor's NAT lines, and parser ids and names
VENDOR_KEYS = {
    "src_ip": ["src", "源IP"],
    "dst_ip": ["dst", "目的IP"],
    "src_port": ["sport", "源端口"],
    "dst_port": ["dport", "目的端口"],
    "protocol": ["proto", "协议"],
    "action": ["action", "NAT类型"],
    "severity": ["severity"],
}
#: fixed value: the vendor's pairs
VENDOR = rf"(?:[{WS}]|^|,)(src|dst|sport|dport|proto|action|severity|源IP|目的IP|源端口|目的端口|协议|NAT类型)(?:=|:)[{WS}]*([^{WS},]+)"
VENDOR_ID, VENDOR_NAME = "parser:sangfor_nat_v1", "SangforAdapter"
GENERIC_ID, GENERIC_NAME = "parser:generic_kv_v1", "GenericKv"
RULES_ID, RULES_NAME = "parser:rule_based_v1", "RuleBased"
#: fixed values: generic keys, lower case
GENERIC_KEYS = {
    "src_ip": ["src", "source", "source_ip", "saddr", "srcaddr", "src_ip", "sip", "srcip"],
    "dst_ip": ["dst", "dest", "destination", "destination_ip", "daddr", "dstaddr", "dst_ip", "dip", "dstip"],
    "src_port": ["sport", "source_port", "srcport", "spt", "src_port"],
    "dst_port": ["dport", "destination_port", "dstport", "dpt", "dst_port"],
    "protocol": ["proto", "protocol", "prot"],
    "action": ["action", "act", "disposition", "nat类型"],
    "severity": ["severity", "level", "priority", "sev"],
    "device_id": ["device", "device_id", "host", "hostname", "dev"],
}
#: fixed values: words that a Chinese key must hold, tried in order
GENERIC_WORDS = [
    ("src_ip", "源.*(ip|地址)|(ip|地址).*源"),
    ("dst_ip", "(目的|目标).*(ip|地址)|(ip|地址).*(目的|目标)"),
    ("src_port", "源.*端口|端口.*源"),
    ("dst_port", "(目的|目标).*端口|端口.*(目的|目标)"),
    ("protocol", "协议"),
    ("action", "动作|nat.*类型|类型.*nat"),
    ("severity", "级别|严重|等级"),
]
#: fixed value: a pair of any line, its value quoted or not
GENERIC = rf"""(?:^|[{WS},;|])([a-zA-Z0-9_一-龥]+)[{WS}]*[:=][{WS}]*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^{WS},;|]+)"""
#: fixed value: what counts as an address in a text (leading zeros do)
IP_IN_TEXT = r"\b((?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))\b"
#: fixed values: hints with the words' mis-decoded forms
PROTOCOL_HINT = rf"(?i)(?:proto|protocol|鍗忚|协议)[{WS}]*[:=][{WS}]*([^{WS},;|]+)"
ACTION_HINT = rf"(?i)(?:action|act|鍔ㄤ綔|动作|nat绫诲瀷|nat类型)[{WS}]*[:=][{WS}]*([^{WS},;|]+)"
#: fixed values: the time at the head of a line, and the bounded tokeniser's pairs
SYSLOG_TIME = r"^(?:<[0-9]+>)?([A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})"
PAIR = r"(?:^|[\s,;|])([^\s,;|=:]+)[=:]\s*([^\s,;|]+)"
#: fixed texts
PARTIAL = "partial parse: minimum searchable tuple incomplete"
NOTHING = "failed parse: no useful canonical fields"
VENDOR_FAILED = "missing required fields: src, dst, action"
GENERIC_FAILED = "generic parser: insufficient fields extracted"
RULES_FAILED = "rule-based parser: no rule matched"

FIELDS = ["device_id", "event_time", "vendor", "product", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "action", "severity"]
TYPES = {"event_time": "timestamp", "src_port": "int", "dst_port": "int"}


def text(pattern_group: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(pattern_group, F.lit(""))


def unquote(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.regexp_replace(F.regexp_replace(value, r'(?s)^"(.*)"$', "$1"), r"(?s)^'(.*)'$", "$1")).otherwise(value)


def first_value(keys: Column, values: Column, name: str) -> Column:
    """The value at the first key that stands for ``name``."""
    return F.get(values, (F.array_position(keys, name) - 1).cast("int"))


@cache
def first_pairs(pattern: str, fields: tuple, words: tuple = (), lower: bool = False, ports: bool = False, quotes: bool = False):
    """An Arrow function of lines: for each of ``fields`` (name, keys) the value of the first
    pair whose key is one of them, or, of no field's keys, holds its ``words``, and whether
    there are pairs. ``ports``: ports that are none are passed over; ``quotes``: come off."""

    def run(raw):
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            raw.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            raw = pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw.cast(pa.binary()).to_pylist()], pa.string())
        raw, marks = raw.cast(pa.large_string()), []
        for code in range(0xE000, 0x10FFFF):  # three characters that no line holds
            if len(marks) < 3 and not pc.any(pc.match_substring(raw, chr(code))).as_py():
                marks.append(chr(code))
            if len(marks) == 3:
                break
        first, middle, last = marks
        cut = pc.split_pattern(pc.replace_substring_regex(raw, pattern, f"{first}\\1{middle}\\2{last}"), first)
        # what stands before a line's first pair is the one piece without a middle
        row, piece = pc.list_parent_indices(cut), pc.list_flatten(cut)
        there = pc.match_substring(piece, middle)
        row, piece = row.filter(there).to_numpy(), piece.filter(there)
        two = pc.list_flatten(pc.split_pattern(piece, middle, max_splits=1))
        key = two.take(pa.array(np.arange(0, len(two), 2)))
        two = pc.list_flatten(pc.split_pattern(two.take(pa.array(np.arange(1, len(two), 2))), last, max_splits=1))
        value = two.take(pa.array(np.arange(0, len(two), 2)))
        if quotes:
            for sign in "\"'":
                value = pc.replace_substring_regex(value, f"(?s)^{sign}(.*){sign}$", "\\1")
        # a name for each different key, not for each pair
        coded = pc.dictionary_encode(pc.utf8_lower(key) if lower else key)
        known = {k: i for i, (_, keys) in enumerate(fields) for k in keys}
        place = {name: i for i, (name, _) in enumerate(fields)}
        other = lambda k: next((place[n] for n, w in words if re.search(w, k)), -1)
        named = np.array([known[k] if k in known else other(k) for k in coded.dictionary.to_pylist()], np.int64)
        field = named[coded.indices.to_numpy()] if len(piece) else np.zeros(0, np.int64)
        good = np.ones(len(piece), bool)
        if ports:
            digits = pc.match_substring_regex(value, r"^\+?[0-9]{1,10}$")
            number = pc.if_else(digits, pc.replace_substring(value, "+", ""), "65536").cast(pa.int64())
            port = np.isin(field, [i for i, (name, _) in enumerate(fields) if name.endswith("port")])
            good = ~port | (number.to_numpy() <= 65535)
        found = []
        for i in range(len(fields)):
            at = np.flatnonzero((field == i) & good)
            rows, where = np.unique(row[at], return_index=True)
            take = np.full(len(raw), -1, np.int64)
            take[rows] = at[where]
            found.append(value.take(pa.array(take, mask=take < 0)).cast(pa.string()))
        some = np.zeros(len(raw), bool)
        some[row] = True
        return pa.StructArray.from_arrays([*found, pa.array(some)], [*(name for name, _ in fields), "some"])

    run.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ", ".join(f"{name} string" for name, _ in fields) + ", some boolean")


def vendor_pairs(raw: Column) -> Column:
    return first_pairs(VENDOR, tuple((n, tuple(keys)) for n, keys in VENDOR_KEYS.items()), ports=True)(raw)


def generic_pairs(raw: Column) -> Column:
    return first_pairs(GENERIC, tuple((n, tuple(keys)) for n, keys in GENERIC_KEYS.items()), tuple(GENERIC_WORDS), lower=True, quotes=True)(raw)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: an explode of one struct keeps Catalyst
    from copying their expressions into every use above it, filters included."""
    kept = [c for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_one")
    return df.select(*kept, one).select(*kept, "_one.*")


def classify(src: Column, dst: Column, protocol: Column, action: Column, error: Column) -> tuple[Column, Column]:
    """Status and error of a searchable tuple: source, destination and one of the rest."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    rest = has(action) | has(protocol)
    whole, some = has(src) & has(dst) & rest, has(src) | has(dst) | rest
    status = F.when(whole, "parsed").when(some, "partial").otherwise("failed")
    reason = F.when(whole, F.lit(None).cast("string")).when(some, PARTIAL).otherwise(F.coalesce(error, F.lit(NOTHING)))
    return status, reason


def result(values: dict[str, Column], failed: Column | None = None) -> Column:
    """A parser's struct; ``failed``: the reason if the parser itself gave up."""
    get = lambda c: values.get(c, F.lit(None)).cast(TYPES.get(c, "string"))
    status, error = classify(get("src_ip"), get("dst_ip"), get("protocol"), get("action"), F.lit(None).cast("string"))
    if failed is None:
        failed = F.lit(None).cast("string")
    none = [F.lit(None).cast(TYPES.get(c, "string")).alias(c) for c in FIELDS]
    nothing = F.struct(*none, F.lit("failed").alias("parse_status"), failed.alias("parse_error"))
    return F.when(failed.isNotNull(), nothing).otherwise(F.struct(*(get(c).alias(c) for c in FIELDS), status.alias("parse_status"), error.alias("parse_error")))


def checked(lines: DataFrame, name: str, values: dict[str, Column], failed: str) -> DataFrame:
    """Adds a parser's struct; ``failed`` is its error where it found none of the tuple."""
    nothing = F.coalesce(*(values[c] for c in ("src_ip", "dst_ip", "protocol", "action"))).isNull()
    return settled(lines, **{name: result(values, F.when(nothing, failed))})


def syslog_time(raw: Column, ingest_time: Column) -> Column:
    # parsed only where there is a time: a failure inside costs an exception a line
    found = F.regexp_extract(raw, SYSLOG_TIME, 1)
    text_of = F.concat_ws(" ", F.year(ingest_time).cast("string"), F.regexp_replace(found, r"\s+", " "))
    return F.when(found != "", F.try_to_timestamp(text_of, F.lit("yyyy MMM d HH:mm:ss")))


def is_vendor(raw: Column) -> Column:
    return raw.rlike("(?i)sangfor|日志类型|nat类型")


def vendor_columns(lines: DataFrame) -> DataFrame:
    """Adds ``vendor_result``. Ports: the first valid value wins."""
    if "_vendor" not in lines.columns:
        lines = settled(lines, _vendor=vendor_pairs(F.col("raw")))
    get = lambda n: F.col(f"_vendor.{n}")
    values = {n: get(n) for n in VENDOR_KEYS}
    values |= {"src_port": u16(get("src_port")), "dst_port": u16(get("dst_port")), "protocol": protocol_name(get("protocol"))}
    values |= {"vendor": F.lit("Sangfor"), "product": F.lit("Firewall"), "event_time": syslog_time(F.col("raw"), F.col("ingest_time"))}
    return checked(lines, "vendor_result", values, VENDOR_FAILED).drop("_vendor")


def generic_columns(lines: DataFrame) -> DataFrame:
    """Adds ``generic_result`` and ``generic_matches``. The first value of a field wins."""
    if "_generic" not in lines.columns:
        lines = settled(lines, _generic=generic_pairs(F.col("raw")))
    get = lambda n: F.col(f"_generic.{n}")
    missing = get("src_ip").isNull() | get("dst_ip").isNull()
    # each once: what uses it below names it several times
    lines = settled(
        lines, _ips=F.when(missing, F.regexp_extract_all("raw", F.lit(IP_IN_TEXT), F.lit(1))),
        _protocol=F.coalesce(get("protocol"), text(F.regexp_extract("raw", PROTOCOL_HINT, 1))),
        _action=F.coalesce(get("action"), text(F.regexp_extract("raw", ACTION_HINT, 1))),
    )
    values = {n: get(n) for n in GENERIC_KEYS}
    values |= {"src_ip": F.coalesce(get("src_ip"), F.get("_ips", F.lit(0))), "dst_ip": F.coalesce(get("dst_ip"), F.get("_ips", F.lit(1)))}
    values |= {"src_port": u16(get("src_port")), "dst_port": u16(get("dst_port")), "protocol": protocol_name(F.col("_protocol")), "action": F.col("_action")}
    lines = lines.withColumn("generic_matches", get("some"))
    return checked(lines, "generic_result", values, GENERIC_FAILED).drop("_ips", "_protocol", "_action", "_generic")


@dataclass
class ParseRule:
    """A pattern with captures, tried in ascending priority. mappings: (target, source,
    transform); source is a capture's name or number; transform is normalize_protocol,
    uppercase, lowercase or None."""

    name: str
    priority: int
    match_pattern: str
    mappings: list[tuple[str, str, str | None]] = field(default_factory=list)


def load_rules(toml: str) -> list[ParseRule]:
    found = tomllib.loads(toml).get("rules", [])
    return checked_rules(
        [ParseRule(r["name"], r["priority"], r["match_pattern"], [(m["target"], m["source"], m.get("transform")) for m in r["field_mappings"]]) for r in found]
    )


def checked_rules(rules: list[ParseRule]) -> list[ParseRule]:
    """The rules by priority; duplicate names and patterns that don't compile are errors."""
    names = [r.name for r in rules]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"duplicate rule name {sorted(twice)[0]!r}")
    for rule in rules:
        try:
            re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", rule.match_pattern))
        except re.error as e:
            raise ValueError(f"invalid pattern in rule {rule.name!r}: {e}") from e
    return sorted(rules, key=lambda r: r.priority)


def rule_columns(lines: DataFrame, rules: list[ParseRule]) -> DataFrame:
    """Adds ``rules_result``: of the first rule that matches and fills a field."""
    found = []
    for rule in checked_rules(rules):
        named = re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", rule.match_pattern)).groupindex
        plain = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", rule.match_pattern)
        values = {"vendor": F.lit(rule.name)}
        for target, source, transform in rule.mappings:
            group = named.get(source, int(source) if source.isdigit() else None)
            if target not in FIELDS or group is None:
                continue
            value = text(F.regexp_extract("raw", plain, group))
            value = {"normalize_protocol": protocol_name, "uppercase": F.upper, "lowercase": F.lower}.get(transform, lambda v: v)(value)
            value = u16(value) if target.endswith("port") else value
            values[target] = F.coalesce(value, F.lit(rule.name)) if target == "vendor" else value
        filled = F.coalesce(*(values.get(c, F.lit(None)).cast("string") for c in ("src_ip", "dst_ip", "protocol", "action"))).isNotNull()
        fields = (values.get(c, F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in FIELDS)
        found.append(F.when(F.col("raw").rlike(plain) & filled, F.struct(*fields)))
    if not found:
        return settled(lines, rules_result=result({}, F.lit(RULES_FAILED)))
    lines = settled(lines, _rule=F.coalesce(*found))
    failed = F.when(F.col("_rule").isNull(), RULES_FAILED)
    return settled(lines, rules_result=result({c: F.col(f"_rule.{c}") for c in FIELDS}, failed)).drop("_rule")


def source_scope(source: Column, with_port: bool = False) -> tuple[Column, Column]:
    """(scope key, known): ``source:scheme://host[:port]``; where the source is no such
    URI, the first 8 digits of its hash, and learning is off."""
    uri = r"^([^:]+?)://(\[[^\]]*\]|[^/:]*)(?::([0-9]+))?(?:/.*)?$"
    many = r"^([^:]+?)://([^/\[]*:[^/]*:[^/]*)(?:/.*)?$"  # a bare IPv6 host
    scheme = F.coalesce(text(F.regexp_extract(source, uri, 1)), text(F.regexp_extract(source, many, 1)))
    host = F.coalesce(text(F.regexp_replace(F.regexp_extract(source, uri, 2), r"^\[|\]$", "")), text(F.regexp_extract(source, many, 2)))
    port = u16(text(F.regexp_extract(source, uri, 3)))
    known = F.coalesce(scheme.isNotNull() & host.isNotNull(), F.lit(False))
    name = F.concat(F.lit("source:"), scheme, F.lit("://"), host)
    if with_port:
        name = F.when(port.isNotNull(), F.concat(name, F.lit(":"), port.cast("string"))).otherwise(name)
    hashed = F.concat(F.lit("source:unknown:"), F.substring(F.sha2(F.coalesce(source, F.lit("")), 256), 1, 8))
    return F.when(known, name).otherwise(hashed), known


def event_id(raw: Column, ingest_time: Column, source: Column) -> Column:
    nanos = (F.unix_micros(ingest_time) * 1000).cast("string")
    return F.sha2(F.concat(raw, nanos, source), 256)


@dataclass
class Adapter:
    """A parser of one's own: detect gives a boolean, parse a struct as result() makes it."""

    parser_id: str
    name: str
    detect: callable
    parse: callable


def pairs(raw: Column, most: int = 64, limit: int = 16384) -> tuple[Column, Column, Column, Column]:
    """Bounded key/value tokens: keys, values, whether pairs and whether the line were cut.
    A line beyond ``limit`` is cut at its last separator."""
    long = F.length(raw) > limit
    cut = F.when(long, F.regexp_extract(F.substring(raw, 1, limit), r"(?s)^(.*)[\s,;|]", 1)).otherwise(raw)
    keys, values = F.regexp_extract_all(cut, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(cut, F.lit(PAIR), F.lit(2))
    return F.slice(keys, 1, most), F.slice(values, 1, most), F.size(keys) > most, long


def parse_events(
    lines: DataFrame,
    rules: list[ParseRule] = (),
    adapters: list[Adapter] = (),
    pins: DataFrame | None = None,
    diagnostics: bool = False,
) -> DataFrame:
    """Canonical events of raw lines (ingest_time, source_addr, raw; other columns stay).

    Order: a scope's pinned parsers (pins: scope_key, parser_ids), then vendor, adapters,
    generic, rules. The vendor parser is tried last where nothing vendor-specific was
    detected. With ``diagnostics``: columns attempts and matched_parser.
    """
    kept = [c for c in lines.columns if c not in ("ingest_time", "source_addr", "raw")]
    lines = settled(lines, _vendor=vendor_pairs(F.col("raw")), _generic=generic_pairs(F.col("raw")))
    lines = rule_columns(generic_columns(vendor_columns(lines)), list(rules)) if rules else generic_columns(vendor_columns(lines))
    ids = [VENDOR_ID, *(a.parser_id for a in adapters), GENERIC_ID, *([RULES_ID] if rules else [])]
    lines = lines.withColumn("scope_key", source_scope(F.col("source_addr"))[0])
    if pins is not None:
        route = F.array(*map(F.lit, ids))
        lines = lines.join(small(pins.select("scope_key", F.col("parser_ids").alias("_pinned"))), "scope_key", "left")
        lines = lines.withColumn("_route", F.array_distinct(F.concat(F.coalesce("_pinned", F.array().cast("array<string>")), route)))

    def attempt(parser_id, name, reason, runs, outcome, last=False):
        if last:
            at = F.lit(1000)
        else:
            at = F.lit(ids.index(parser_id) + 1) if pins is None else F.array_position(F.col("_route"), parser_id).cast("int")
        return F.when(
            F.coalesce(runs, F.lit(False)),
            F.struct(at.alias("at"), F.lit(parser_id).alias("parser_id"), F.lit(name).alias("name"), F.lit(reason).alias("reason"), outcome.alias("result")),
        )

    detected = is_vendor(F.col("raw"))
    any_detected = detected
    for a in adapters:
        any_detected = any_detected | F.coalesce(a.detect(F.col("raw")), F.lit(False))
    tries = [attempt(VENDOR_ID, VENDOR_NAME, "compatibility can_parse matched", detected, F.col("vendor_result"))]
    tries += [attempt(a.parser_id, a.name, "compatibility can_parse matched", a.detect(F.col("raw")), a.parse(F.col("raw"))) for a in adapters]
    tries.append(attempt(GENERIC_ID, GENERIC_NAME, "generic key/value detector matched", F.col("generic_matches"), F.col("generic_result")))
    if rules:
        tries.append(attempt(RULES_ID, RULES_NAME, "rule parser configured", F.lit(True), F.col("rules_result")))
    fallback = "compatibility fallback after generic and rule parsers"
    tries.append(attempt(VENDOR_ID, VENDOR_NAME, fallback, ~any_detected, F.col("vendor_result"), last=True))
    tries += [attempt(a.parser_id, a.name, fallback, ~any_detected, a.parse(F.col("raw")), last=True) for a in adapters]

    tried = F.array_compact(F.array(*tries))  # without pins in order as it is
    lines = settled(lines, _all=tried if pins is None else F.array_sort(tried, lambda x, y: x["at"] - y["at"]))
    by = lambda status: F.get(F.filter("_all", lambda t: t["result"]["parse_status"] == status), F.lit(0))
    lines = settled(lines, _won=F.coalesce(by("parsed"), by("partial")))
    said = F.transform("_all", lambda t: F.concat(t["name"], F.lit(": "), F.coalesce(t["result"]["parse_error"], F.lit("failed"))))
    none = F.concat(F.lit("no parser matched; attempted ["), F.array_join(said, ", "), F.lit("]"))
    error = F.when(F.col("_won").isNull(), none).otherwise(F.col("_won.result.parse_error"))
    lines = settled(lines, _error=error, event_id=event_id(F.col("raw"), F.col("ingest_time"), F.col("source_addr")))
    return lines.select(
        "event_id", "ingest_time", "source_addr",
        *(F.col(f"_won.result.{c}").alias(c) for c in FIELDS), "raw",
        F.coalesce(F.col("_won.result.parse_status"), F.lit("failed")).alias("parse_status"),
        F.col("_error").alias("parse_error"),
        "scope_key", *kept,
        *([F.col("_all").alias("attempts"), F.col("_won.parser_id").alias("matched_parser")] if diagnostics else []),
    )


def apply_learned(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Fill empty fields of partial and failed events by the active rules of their scope,
    in order of rule_id, and classify again. rules: rule_id, scope_key, raw_key,
    canonical_field, value_type. Adds applied_rules and failed_rules (at most 8 each)."""
    packed = rules.groupBy("scope_key").agg(F.array_sort(F.collect_list(F.struct("rule_id", "raw_key", "canonical_field", "value_type"))).alias("_rules"))
    rows = events.drop("applied_rules", "failed_rules").join(small(packed), "scope_key", "left")
    keys, values, _, _ = pairs(F.col("raw"))
    rows = settled(rows, _k=keys, _v=values)
    open_ = (F.col("parse_status") != "parsed") & F.col("_rules").isNotNull()

    def rated(r):
        value = unquote(first_value(F.col("_k"), F.col("_v"), r["raw_key"]))
        empty = F.lit(False)
        for c in FIELDS[4:]:
            empty = F.when(r["canonical_field"] == c, F.coalesce(F.col(c).cast("string") == "", F.lit(True))).otherwise(empty)
        return F.struct(r["rule_id"].alias("rule_id"), r["canonical_field"].alias("canonical_field"), normal_value(value, r["value_type"]).alias("value"), (empty & value.isNotNull()).alias("tried"))

    rows = settled(rows, _tried=F.when(open_, F.filter(F.transform("_rules", rated), lambda r: r["tried"])))
    good = lambda c: F.get(F.filter("_tried", lambda r: (r["canonical_field"] == c) & r["value"].isNotNull()), F.lit(0))
    rows = settled(rows, _fills=F.array_compact(F.array(*(good(c) for c in FIELDS[4:]))))
    fill = lambda c: F.get(F.filter("_fills", lambda r: r["canonical_field"] == c), F.lit(0))["value"]
    after = {}
    for c in FIELDS[4:]:
        value = fill(c).cast(TYPES.get(c, "string"))
        old = F.col(c) if c in TYPES else text(F.col(c))
        after[c] = F.when(open_, F.coalesce(old, value)).otherwise(F.col(c))
    rows = settled(rows, **after)
    status, error = classify(F.col("src_ip"), F.col("dst_ip"), F.col("protocol"), F.col("action"), F.col("parse_error"))
    changed = open_ & (F.size("_fills") > 0)
    rows = rows.withColumn("_s", F.when(changed, status).otherwise(F.col("parse_status"))).withColumn("parse_error", F.when(changed, error).otherwise(F.col("parse_error")))
    names = lambda a: F.slice(F.transform(a, lambda r: r["rule_id"]), 1, 8)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("applied_rules", F.coalesce(names(F.col("_fills")), none))
    rows = rows.withColumn("failed_rules", F.coalesce(names(F.filter("_tried", lambda r: r["value"].isNull())), none))
    return rows.withColumn("parse_status", F.col("_s")).drop("_rules", "_k", "_v", "_tried", "_fills", "_s")


def normal_value(value: Column, kind: Column) -> Column:
    """A raw value as its type wants it, null if it doesn't fit."""
    return (
        F.when(kind == "ip", F.when(is_ip(value), value))
        .when(kind == "port", u16(value).cast("string"))
        .when(kind == "protocol", protocol_name(F.lower(value)))
        .otherwise(value)
    )
