"""Late rows, replayed batches and failed renames; learned state and search exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.functions.net import small
from siftline.operators import joins, learn, parse
from siftline.operators.search import Search
from siftline.schema import EVENT_COLUMNS
from siftline.sources import sinks
from siftline.streaming import stream

T0 = dt.datetime(2026, 3, 4, 5, 6, 7)


def events(spark, rows, *more):
    lines = [(T0 + dt.timedelta(minutes=m), source, raw) for source, m, raw in rows]
    return parse.parse_events(spark.createDataFrame(lines, "ingest_time timestamp, source_addr string, raw string")).select(*EVENT_COLUMNS, *more)


LINE = "src=10.9.8.7 dst=9.9.9.9 proto=6 action=deny n="


def test_sync_copies_late_rows(spark, tmp_path):
    target = str(tmp_path / "copy")
    first = events(spark, [("udp://a:1", m, f"{LINE}{m}") for m in (0, 60, 120)])
    assert stream.sync(first, target) == 3
    late = events(spark, [("udp://a:1", m, f"{LINE}late{m}") for m in (30, 119, -60 * 24 * 5)])
    assert stream.sync(first.union(late), target) == 2  # the third is later than two days
    assert stream.sync(first.union(late), target, late=None) == 1
    assert stream.sync(first.union(late), target, late=None) == 0


def test_replace_puts_the_old_table_back(spark, tmp_path):
    target = str(tmp_path / "hot")
    rows = events(spark, [("udp://a:1", 0, LINE)])
    sinks.replace_events(rows, target, 1)
    sinks.replace_events(rows.union(events(spark, [("udp://a:1", 1, LINE)])), target, 2)
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(ValueError):
        sinks.replace_events(rows, target, 2)
    assert spark.read.parquet(target).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir() if ".old-" in p.name) == []
    nowhere = str(tmp_path / "missing" / "hot")
    sinks.replace_events(rows, nowhere, 1)
    assert spark.read.parquet(nowhere).count() == 1


def test_a_replayed_batch_counts_once(spark, tmp_path):
    root = str(tmp_path / "state")
    batch = events(spark, [("udp://10.0.0.9:514", m, f"src=10.1.1.{m} dst=9.9.9.9 actName=deny") for m in range(1, 6)])
    learner = stream.learn_batch(root)
    learner(batch, 0)
    learner(batch, 0)
    assert {r.sample_count for r in sinks.state(spark, root, "rules").collect()} == {5}
    learner(batch, 1)
    rules = sinks.state(spark, root, "rules")
    assert {r.sample_count for r in rules.collect()} == {10}
    assert learn.state_listing(rules, "active").count() == 0 and learn.state_listing(rules).count() == 1


def test_fingerprints_and_floods(spark):
    # words and numbers are alike, punctuation is not
    rows = events(spark, [("udp://h:1", 0, f"nothing {m} here") for m in range(5)] + [("udp://h:1", 0, "nothing" + "!" * m) for m in range(1, 4)], "scope_key")
    assert learn.failure_fingerprints(rows).count() == 4
    got = learn.flood_counts(rows, most=3).first()
    assert (got.shapes, got.sources, got.held) == (4, 1, True) and got.until == got.minute + dt.timedelta(seconds=300)
    assert learn.floods(rows).count() == 0
    long = "z " * 200
    assert learn.failure_fingerprints(events(spark, [("udp://h:1", 0, long + "?"), ("udp://h:1", 0, long + "#")], "scope_key")).count() == 2


def test_small_sides_are_sent_and_large_ones_not(spark):
    rows = spark.range(50).select("id", F.lit("x").alias("name"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(spark.range(10).join(small(rows, 50), "id"))
    assert small(rows, 49) is rows
    assert {r.id for r in small(rows, 50).collect()} == set(range(50))


def test_networks_need_a_prefix(spark):
    rules = spark.createDataFrame([(1, "9.9.9.9", "bare", True, False), (2, "9.9.0.0/16", "net", True, False)], "rule_order int, cidr string, name string, enabled boolean, deleted boolean")
    ips = spark.createDataFrame([("9.9.9.9",)], "ip string")
    assert [tuple(r) for r in joins.cidr_names(ips, rules).collect()] == [("9.9.9.9", "net")]


def test_search_export(spark, tmp_path):
    hot = events(spark, [("udp://a:1", m, f"{LINE}{m}") for m in range(3)])
    cold = events(spark, [("udp://b:1", m, f"{LINE}{m}") for m in range(4)])
    n = sinks.search_export(Search(device="udp://", limit=5), str(tmp_path / "out"), hot, cold, kind="csv")
    assert n == 5 and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5
