"""Queries on all rows: no cap or subset of lines decides a result."""

import datetime as dt

from siftline.operators import parse, search
from siftline.plans import queries
from siftline.sources import tables

T0 = dt.datetime(2026, 5, 16, 1, 20, 1)
FULL = "src=1.1.1.1 dst=8.8.8.8 proto=17 action=allow"


def test_tier_dedup_has_no_cap(spark, monkeypatch):
    days = [dt.datetime(2024, 1, d) for d in (2, 9, 12, 19, 20, 28)]
    rows = [(i, days[i % 6] + dt.timedelta(seconds=i), "udp://10.0.0.1:514", f"{FULL} n={i}") for i in range(36)]
    lines = spark.createDataFrame(rows, "line_id long, ingest_time timestamp, source_addr string, raw string")
    monkeypatch.setattr(queries, "events", lambda *_: parse.parse_events(lines))
    monkeypatch.setattr(search, "QUERY_LIMIT", 5)
    got = queries.tier_search_dedup(spark, "").collect()
    assert len({r.event_id for r in got}) == len(got) == 36 and {r.n for r in got} == {1}
    assert sorted(r.tier_rank for r in got) == [0] * 24 + [1] * 12


def test_stored_tables_are_pruned(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20), "udp://10.0.0.1:514", f"{FULL} n={i}") for i in range(60)]
    lines = spark.createDataFrame(rows, "line_id long, ingest_time timestamp, source_addr string, raw string")
    tables.store(parse.parse_events(lines), f"{tmp_path}/events")
    table = tables.stored(spark, f"{tmp_path}/events")
    got = search.within(table, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 23))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 6 and "PartitionFilters: [isnotnull(ingest_day" in plan
    got = search.matching(table, search.Search(date_from="2024-01-03", date_to="2024-01-04"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 6 and "GreaterThanOrEqual(event_time" in plan
    got = search.matching(table, search.Search(day="20240105"))
    assert got.count() == 3


def test_log_days_reads_every_shape(spark, monkeypatch):
    rows = spark.createDataFrame([(3, "2026-05-16T10:00:00Z a"), (0, "date=2026-05-17"), (6, "none")], "shape int, raw string")
    monkeypatch.setattr(queries, "lines", lambda *_: rows)
    assert {r.day for r in queries.log_days(spark, "").collect()} == {"2026-05-16", "2026-05-17"}
