"""Learning field rules from lines that were not parsed, as batch steps over state tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.net import wilson_lower_bound
from siftline.operators.parse import GENERIC_KEYS, normal_value, pairs, settled, source_scope, unquote

#: fixed values: further keys of candidates, and the value type of each field
MORE_KEYS = {"dst_ip": ["target_ip", "targetaddr", "target_addr"], "action": ["actname", "nat_type"]}
VALUE_TYPES = {"src_ip": "ip", "dst_ip": "ip", "src_port": "port", "dst_port": "port", "protocol": "protocol", "action": "action", "severity": "string"}
MIN_SAMPLES, ACTIVATION = 100, 0.95
ROLLBACK_SAMPLES, ROLLBACK_FAILED, ROLLBACK_CONFLICT = 50, 0.25, 0.10
#: fixed texts
CONFLICT = "rollback: active rule value conversion conflict threshold exceeded"
FAILED = "rollback: attributed failure threshold exceeded"


def candidates(events: DataFrame) -> DataFrame:
    """Per event and fitting pair: rule_id, scope_key, raw_key, canonical_field,
    value_type, won. Only partial and failed events of a known source count, and lines
    with more pairs than the bound don't."""
    keys, values, cut, _ = pairs(F.col("raw"))
    scope, known = source_scope(F.col("source_addr"))
    rows = events.where("parse_status <> 'parsed'").withColumn("scope_key", scope).where(known)
    rows = settled(rows, _k=keys, _v=values, _cut=cut).where(~F.col("_cut"))
    rows = rows.withColumn("_pair", F.explode(F.arrays_zip("_k", "_v"))).withColumn("raw_key", F.col("_pair._k")).withColumn("value", F.col("_pair._v"))
    low, field, kind, empty = F.lower("raw_key"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for name in VALUE_TYPES:
        fits = low.isin([k for k in GENERIC_KEYS[name] if k != "nat类型"] + MORE_KEYS.get(name, []))
        field = F.when(fits, name).otherwise(field)
        kind = F.when(fits, VALUE_TYPES[name]).otherwise(kind)
        empty = F.when(fits, F.col(name).isNull()).otherwise(empty)
    rows = settled(rows, canonical_field=field, value_type=kind, _empty=empty).where("_empty")
    # what applying the rule would do uses the key's first pair in the line
    rows = rows.where(normal_value(F.col("value"), F.col("value_type")).isNotNull())
    first = unquote(F.get("_v", (F.array_position("_k", F.col("raw_key")) - 1).cast("int")))
    won = normal_value(first, F.col("value_type")).isNotNull()
    rule_id = F.concat_ws(":", F.lit("rule"), "scope_key", "raw_key", "canonical_field")
    return rows.select("event_id", rule_id.alias("rule_id"), "scope_key", "raw_key", "canonical_field", "value_type", won.alias("won"))


def observed(state: DataFrame, found: DataFrame) -> DataFrame:
    """State after a batch of candidates: new rules start as shadow; only shadow and
    recovering rules count samples and wins."""
    fresh = found.groupBy("rule_id", "scope_key", "raw_key", "canonical_field", "value_type").agg(
        F.count("*").alias("_n"), F.sum(F.col("won").cast("long")).alias("_w")
    )
    keys = ["rule_id", "scope_key", "raw_key", "canonical_field", "value_type"]
    rows = state.join(fresh, keys, "full").withColumn("status", F.coalesce("status", F.lit("shadow")))
    counts = F.col("status").isin("shadow", "shadow_recovering") & F.col("_n").isNotNull()
    add = lambda c, x: F.coalesce(c, F.lit(0)) + F.when(counts, F.col(x)).otherwise(0)
    rows = rows.withColumn("sample_count", add("sample_count", "_n")).withColumn("wins", add("wins", "_w"))
    confidence = F.when(counts, wilson_lower_bound(F.col("wins"), F.col("sample_count"))).otherwise(F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("confidence", confidence).select(state.columns)


def activated(state: DataFrame, min_samples: int = MIN_SAMPLES, bound: float = ACTIVATION, auto: bool = True) -> DataFrame:
    """Shadow rules with enough samples and a high enough bound become active."""
    ready = (F.col("status") == "shadow") & (F.col("sample_count") >= min_samples) & (wilson_lower_bound(F.col("wins"), F.col("sample_count")) >= bound)
    return state.withColumn("status", F.when(ready & F.lit(auto), "active").otherwise(F.col("status")))


def active_rules(state: DataFrame) -> DataFrame:
    return state.where("status = 'active'").orderBy("rule_id")


def attributed(events: DataFrame) -> DataFrame:
    """Per rule after activation: total, failed, conflicts. events: applied_rules,
    failed_rules and the status that came out."""
    one = lambda c, bad, conflict: F.transform(c, lambda r: F.struct(r.alias("rule_id"), bad.alias("bad"), F.lit(conflict).alias("conflict")))
    # both lists of an event together, so that what made the events is done once
    both = F.array(one("applied_rules", F.col("parse_status") != "parsed", False), one("failed_rules", F.lit(True), True))
    rows = events.select(F.explode(F.flatten(F.array_compact(both))).alias("_rule")).select("_rule.*")
    n = lambda c: F.sum(F.col(c).cast("long"))
    return rows.groupBy("rule_id").agg(F.count("*").alias("total"), n("bad").alias("failed"), n("conflict").alias("conflicts"))


def summed(counters: DataFrame) -> DataFrame:
    """Counters of several batches added up by rule."""
    return counters.groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("total", "failed", "conflicts")])


def rolled_back(state: DataFrame, counters: DataFrame) -> DataFrame:
    """Active rules with too many failures or conflicts are disabled, with the reason."""
    rows = state.join(counters, "rule_id", "left")
    conflict = F.col("conflicts") / F.col("total") >= ROLLBACK_CONFLICT
    failed = F.col("failed") / F.col("total") >= ROLLBACK_FAILED
    off = F.coalesce((F.col("status") == "active") & (F.col("total") >= ROLLBACK_SAMPLES) & (conflict | failed), F.lit(False))
    reason = F.when(off, F.when(conflict, CONFLICT).otherwise(FAILED)).otherwise(F.col("disabled_reason"))
    return rows.withColumn("disabled_reason", reason).withColumn("status", F.when(off, "disabled").otherwise(F.col("status"))).select(state.columns)


def parser_profiles(parsed: DataFrame) -> DataFrame:
    """Per scope and parser: successes, partials, failures, last time. parsed: the engine's
    output with diagnostics."""
    rows = parsed.select("scope_key", "ingest_time", F.explode("attempts").alias("a"))
    n = lambda s: F.sum((F.col("a.result.parse_status") == s).cast("long"))
    return rows.groupBy("scope_key", F.col("a.parser_id").alias("parser_id"), F.col("a.name").alias("parser_name")).agg(
        n("parsed").alias("success_count"), n("partial").alias("partial_count"), n("failed").alias("fail_count"), F.max("ingest_time").alias("last_seen")
    )


def profile_deltas(parsed: DataFrame, most: int = 4096) -> DataFrame:
    """(scope_key, parser_id, status, n, gap) of the engine's attempts. A task counts at
    most ``most`` different keys at a time; attempts beyond are not counted and their
    scopes are marked: their counts have a gap, all others are exact."""

    def run(batches):
        counts, gaps = {}, set()
        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns)):
                if key in counts or len(counts) < most:
                    counts[key] = counts.get(key, 0) + 1
                else:
                    gaps.add(key[0])
        rows = [(*k, n, False) for k, n in counts.items()] + [(s, None, None, 0, True) for s in gaps]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["scope_key", "parser_id", "status", "n", "gap"])

    tried = parsed.select("scope_key", F.explode("attempts").alias("a")).select("scope_key", "a.parser_id", F.col("a.result.parse_status").alias("status"))
    parts = tried.mapInArrow(run, "scope_key string, parser_id string, status string, n long, gap boolean")
    marked = parts.groupBy("scope_key").agg(F.max("gap").alias("gap"))
    sums = parts.where("parser_id is not null").groupBy("scope_key", "parser_id", "status").agg(F.sum("n").alias("n"))
    return sums.join(marked, "scope_key")


def scope_listing(events: DataFrame, intervals: DataFrame | None = None, as_of=None) -> DataFrame:
    """Scopes with their lines, whether they are buckets of unknown sources, their last
    time and, at ``as_of``, the share of lines that rules apply to; the latest first."""
    scope, known = source_scope(F.col("source_addr"))
    rows = events.groupBy(scope.alias("scope_key")).agg((~F.max(known)).alias("unknown_source"), F.count("*").alias("n"), F.max("ingest_time").alias("last_seen"))
    if intervals is not None:
        at = F.lit(as_of)
        now = intervals.where((F.col("start") <= at) & (at < F.col("stop"))).select("scope_key", "share", F.col("stop").alias("until"), "backoff")
        rows = rows.join(now, "scope_key", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    return rows.orderBy(F.desc("last_seen"), "scope_key")


def alias_listing(events: DataFrame) -> DataFrame:
    return source_aliases(events).orderBy(F.desc("last_seen"), "source_key", "raw_source", "device_id")


def diagnostic_listing(parsed: DataFrame) -> DataFrame:
    return failure_fingerprints(parsed).orderBy(F.desc("last_seen"), "fingerprint")


def state_listing(state: DataFrame, status: str | None = None) -> DataFrame:
    """Rules in the listings' fixed order: scope, field, raw key; of one status if given."""
    rows = state if status is None else state.where(F.col("status") == status)
    return rows.orderBy("scope_key", "canonical_field", "raw_key", "rule_id")


def status_counts(state: DataFrame) -> DataFrame:
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    return state.agg(n("active").alias("active"), n("shadow", "shadow_recovering").alias("shadow"), n("disabled").alias("disabled"))


def fingerprint() -> Column:
    """Of a failed event: a hash of scope, error class, missing fields, keys and the shape
    of the whole line, in which numbers and words are one character each."""
    keys, _, _, _ = pairs(F.col("raw"))
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("src_ip", "dst_ip", "protocol", "action")))
    shape = F.regexp_replace(F.regexp_replace("raw", "[0-9]+", "9"), "[A-Za-z]+", "a")
    error = F.regexp_extract("parse_error", r"^([^\[]*)", 1)
    return F.sha2(F.concat_ws("\x1f", "scope_key", error, missing, F.array_join(F.array_sort(keys), ","), shape), 256)


def failure_fingerprints(parsed: DataFrame) -> DataFrame:
    """Failures by fingerprint, with the least reason and line of each."""
    rows = parsed.where("parse_status = 'failed'")
    return rows.groupBy("scope_key", fingerprint().alias("fingerprint")).agg(
        F.min("parse_error").alias("reason"), F.min("raw").alias("sample"), F.count("*").alias("n"), F.max("ingest_time").alias("last_seen")
    )


def flood_counts(parsed: DataFrame, most: int = 200, hold: str = "300 seconds") -> DataFrame:
    """Distinct fingerprints of failures and raw sources of each scope-minute, whether
    either is more than ``most``, and until when the guard holds then."""
    rows = parsed.where("parse_status = 'failed'").groupBy("scope_key", F.date_trunc("minute", "ingest_time").alias("minute"))
    rows = rows.agg(F.count_distinct(fingerprint()).alias("shapes"), F.count_distinct("source_addr").alias("sources"))
    held = (F.col("shapes") > most) | (F.col("sources") > most)
    return rows.withColumn("held", held).withColumn("until", F.when(held, F.col("minute") + F.expr(f"interval {hold}")))


def floods(parsed: DataFrame, most: int = 200, hold: str = "300 seconds") -> DataFrame:
    """The scope-minutes that trip the guard."""
    return flood_counts(parsed, most, hold).where("held")


def source_aliases(events: DataFrame) -> DataFrame:
    """Raw sources of each scope with first and last time, and the scope's share of them."""
    rows = events.groupBy(source_scope(F.col("source_addr"))[0].alias("source_key"), F.col("source_addr").alias("raw_source"), "device_id")
    return rows.agg(F.min("ingest_time").alias("first_seen"), F.max("ingest_time").alias("last_seen"), F.count("*").alias("n"))


