"""Schemas of raw lines, canonical events and rollups."""

from __future__ import annotations

RAW = "ingest_time timestamp, source_addr string, raw string"
EVENT = (
    "event_id string, ingest_time timestamp, source_addr string, device_id string, event_time timestamp, vendor string, "
    "product string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, action string, "
    "severity string, raw string, parse_status string, parse_error string"
)
EVENT_COLUMNS = [f.split()[0] for f in EVENT.split(", ")]
SLIM_COLUMNS = [c for c in EVENT_COLUMNS if c not in ("event_id", "device_id", "raw", "parse_error")]
SPOOL = "offset long, ingest_time timestamp, source_addr string, raw string"
RULE = (
    "rule_id string, scope_key string, raw_key string, canonical_field string, value_type string, status string, "
    "confidence double, wins long, sample_count long, disabled_reason string"
)
COUNTERS = "rule_id string, total long, failed long, conflicts long"
