"""History views kept by a stream, and the learning loop: replays, late rows, rollback."""

import datetime as dt

from pyspark.sql import functions as F

from siftline.operators import learn, metrics, parse
from siftline.sources import sinks
from siftline.streaming import stream

T0 = dt.datetime(2026, 3, 4, 5, 58, 7)


def events(spark, rows):
    lines = [(T0 + dt.timedelta(minutes=m), source, raw) for source, m, raw in rows]
    return parse.parse_events(spark.createDataFrame(lines, "ingest_time timestamp, source_addr string, raw string")).drop("scope_key")


def test_history_views_count_each_row_once(spark, tmp_path):
    history, views = str(tmp_path / "history"), str(tmp_path / "views")
    first = events(spark, [("udp://a:1", m, f"src=10.9.8.7 dst=9.9.9.9 proto=6 action=deny n={m}") for m in range(4)] * 2)
    more = events(spark, [("udp://a:1", m, f"src=10.9.8.7 dst=9.9.9.9 proto=6 action=deny n={m}") for m in range(2, 6)] + [("udp://b:1", -60 * 24, "nothing")])
    keep = stream.history_batch(history, views)
    keep(first, 0)
    keep(first, 0)  # replayed whole
    keep(more, 1)
    # a batch that was cut off after its aggregates and before its rows were stored
    cut_off = events(spark, [("udp://c:1", 9, "later")])
    with_views_only = stream.history_batch(str(tmp_path / "elsewhere"), views)
    with_views_only(cut_off, 2)
    keep(cut_off, 2)
    stored = spark.read.parquet(history)
    assert stored.count() == 8
    for name, (unit, keys) in stream.VIEWS.items():
        columns = ["bucket", *keys, "total_count", "raw_bytes", "last_seen"]
        want = metrics.history_view(stored, unit, keys).select(columns)
        assert sorted(map(str, stream.stored_view(spark, views, name).select(columns).collect())) == sorted(map(str, want.collect()))
    pruned = stream.stored_view(spark, views, "source").where(F.col("bucket_day") == dt.date(2026, 3, 3))
    assert [r.source_addr for r in pruned.collect()] == ["udp://b:1"]
    assert "PartitionFilters: [isnotnull(bucket_day" in pruned._jdf.queryExecution().executedPlan().toString()


def test_learned_rules_are_applied_and_rolled_back(spark, tmp_path):
    root, hot = str(tmp_path / "state"), str(tmp_path / "hot")
    run = stream.learn_batch(root, hot, min_samples=20, bound=0.8)
    good = lambda a, b: events(spark, [("udp://10.0.0.9:514", m, f"src=10.1.1.1 dst=9.9.9.9 actName=deny n={m}") for m in range(a, b)])
    run(good(0, 30), 0)
    rules = {r.raw_key: r.status for r in sinks.state(spark, root, "rules").collect()}
    assert rules == {"actName": "active"}
    assert {r.action for r in spark.read.parquet(hot).collect()} == {None}  # it was not active yet
    run(good(30, 40), 1)
    run(good(30, 40), 1)
    assert spark.read.parquet(hot).where("action = 'deny' and parse_status = 'parsed'").count() == 10
    assert [tuple(r) for r in sinks.state(spark, root, "counters").collect()] == [("rule:source:udp://10.0.0.9:actName:action", 10, 0, 0)]
    # lines that the rule fills and that stay partial count against it
    run(events(spark, [("udp://10.0.0.9:514", m, f"src=10.1.1.1 actName=deny n={m}") for m in range(100, 160)]), 2)
    rule = sinks.state(spark, root, "rules").where("raw_key = 'actName'").first()
    assert (rule.status, rule.disabled_reason) == ("disabled", learn.FAILED)
    run(good(200, 205), 3)
    assert spark.read.parquet(hot).where("action is null and raw like '%dst=%'").count() == 35
