"""What keeps the queries in proportion to their tables: short tasks, work done once."""

import datetime as dt

from pyspark.sql import functions as F

from siftline.operators import metrics, parse
from siftline.plans import lines as plans
from siftline.sources import rollups, sinks
from siftline.streaming import stream

T0 = dt.datetime(2026, 3, 4, 5, 58, 7)


def raw_lines(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), "udp://a:1", raw) for s, raw in rows], "ingest_time timestamp, source_addr string, raw string")


def test_a_large_table_is_parsed_in_short_tasks(spark, monkeypatch):
    monkeypatch.setattr(plans, "TASK_LINES", 10)
    found = plans.lines(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= found.count() / 10


def test_pairs_are_cut_by_arrow_as_the_patterns_say(spark):
    odd = [
        (0, None), (1, ""), (2, "no pairs"), (3, 'SRC="1.1.1.1" dst=\'2.2.2.2\' sport = +53 dport: 70000, proto=6;act="a \\" b"'),
        (4, "src=1.1.1.1 src=3.3.3.3 dst=\ue000\ue001\ue002 action=\ue000"), (5, "源IP：x 源地址=4.4.4.4,目标 ip=5.5.5.5 动作=deny 协议=17"),
        (6, "Sangfor src=1.1.1.1 sport=x sport=99999 sport=80 源端口:81 dst=2.2.2.2 action=a"), (7, "x=\"'y'\" host='\"z\"' level=\"'w'\""),
    ]
    rows = raw_lines(spark, odd).withColumn("g", parse.generic_pairs(F.col("raw"))).withColumn("v", parse.vendor_pairs(F.col("raw")))
    got = {(r.ingest_time - T0).seconds: r for r in rows.collect()}
    assert [got[i].g.some for i in range(8)] == [False, False, False, True, True, True, True, True]
    assert (got[3].g.src_ip, got[3].g.dst_ip, got[3].g.src_port, got[3].g.dst_port, got[3].g.action) == ("1.1.1.1", "2.2.2.2", "+53", "70000", 'a \\" b')
    assert (got[4].g.src_ip, got[4].g.dst_ip, got[4].g.action) == ("1.1.1.1", "\ue000\ue001\ue002", "\ue000")
    assert (got[5].g.src_ip, got[5].g.action, got[5].g.protocol) == ("4.4.4.4", "deny", "17")
    assert (got[6].v.src_port, got[6].v.src_ip, got[6].v.action) == ("80", "1.1.1.1", "a")
    assert (got[7].g.device_id, got[7].g.severity) == ('"z"', "w")
    # the same of Spark's own patterns
    keys = F.regexp_extract_all("raw", F.lit(parse.GENERIC), F.lit(1))
    for r in raw_lines(spark, odd).select("ingest_time", (F.size(keys) > 0).alias("some")).collect():
        assert bool(r.some) == got[(r.ingest_time - T0).seconds].g.some
    plan = parse.parse_events(raw_lines(spark, odd))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_a_sync_reads_each_day_once(spark, tmp_path, monkeypatch):
    hot, copy = str(tmp_path / "hot"), str(tmp_path / "copy")
    rows = parse.parse_events(raw_lines(spark, [(86400 * (n % 3) + n, f"src=1.1.1.1 dst=2.2.2.2 proto=6 n={n}") for n in range(60)])).drop("scope_key")
    sinks.append_events(rows, hot)
    calls = []
    monkeypatch.setattr(stream, "append_events", lambda batch, target: calls.append(1) or sinks.append_events(batch, target))
    assert stream.sync(spark.read.parquet(hot), copy, limit=4) == 60
    assert len(calls) == 3  # pages of four rows were fifteen
    assert stream.sync(spark.read.parquet(hot), copy, limit=4) == 0
    assert spark.read.parquet(copy).select("event_id").distinct().count() == 60


def test_a_batch_is_parsed_once_for_table_and_rollup(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    lines = raw_lines(spark, [(60 * n, f"src=1.1.1.1 dst=2.2.2.2 proto=6 n={n}") for n in range(20)])
    rows = parse.parse_events(lines.mapInArrow(count, lines.schema)).drop("scope_key")
    hot, kept = str(tmp_path / "hot"), rollups.Rollups(spark, str(tmp_path / "r"))
    assert rollups.insert_with_rollup(rows, hot, kept, "a") == 20
    assert made.value == 20
    assert kept.rows().agg(F.sum("total_count")).first()[0] == metrics.minute_rollup(rows).agg(F.sum("total_count")).first()[0] == 20
