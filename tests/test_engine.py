import datetime as dt
import gzip
import io
import json
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from siftline.functions import net
from siftline.operators import joins, lifecycle, metrics, parse, search
from siftline.schema import EVENT_COLUMNS
from siftline.sources import files, sinks
from siftline.streaming import stream

T0 = dt.datetime(2026, 5, 16, 1, 20, 1)


def events(spark, rows):
    """rows: (source, seconds after T0, raw)"""
    lines = [(T0 + dt.timedelta(seconds=s), source, raw) for source, s, raw in rows]
    return parse.parse_events(spark.createDataFrame(lines, "ingest_time timestamp, source_addr string, raw string")).select(EVENT_COLUMNS)


FULL = "src=1.1.1.1 dst=8.8.8.8 proto=17 action=allow"
SOME = [("udp://192.168.0.1:514", 0, FULL), ("udp://192.168.0.1:514", 58, FULL + " x=1"), ("udp://192.168.0.2:514", 59, "src=1.1.1.1"), ("tcp://h:1", 120, "nothing here")]


def test_scalars(spark):
    low, high = net.cidr_bounds(F.lit("10.1.2.3/8"))
    row = spark.range(1).select(
        net.u16(F.lit("65536")).alias("a"), net.u16(F.lit("80")).alias("b"), net.is_public(net.ipv4_number(F.lit("100.64.0.1"))).alias("c"),
        net.is_public(net.ipv4_number(F.lit("8.8.8.8"))).alias("d"), low.alias("e"), high.alias("f"), net.wilson_lower_bound(F.lit(0), F.lit(0)).alias("g"),
        net.day_of(F.lit("2026-02-30")).alias("h"), net.day_of(F.lit("20260516")).alias("i"), net.byte_size(F.lit(2048)).alias("j"),
        net.flexible_time(F.lit("2026-05-16T01:20:00Z")).alias("k"), net.region_parts(F.lit("美国|0|0|谷歌|US"))[0].alias("l"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i, row.j) == (None, 80, False, True, 10 << 24, (11 << 24) - 1, 0.0, None, dt.date(2026, 5, 16), "2.0 KB")
    assert row.k == dt.datetime(2026, 5, 16, 1, 20) and row.l == "美国|谷歌"


def test_search_filters(spark):
    rows = events(spark, SOME).persist()
    assert search.search_hot(rows, search.Search(protocol="17", dst_ip="8.8.8.8", day="2026-05-16")).count() == 2
    assert search.search_hot(rows, search.Search()).count() == 3
    assert search.search_hot(rows, search.Search(include_failed=True, limit=2)).count() == 2
    assert search.search_hot(rows, search.Search(keyword="x=1")).count() == 1
    with pytest.raises(ValueError):
        search.Search(date_from="2026-05-02", date_to="2026-05-01")
    with pytest.raises(ValueError):
        search.Search(scope="cold")


def test_rollup_counts_and_refresh(spark):
    rows = events(spark, SOME).persist()
    whole = metrics.minute_rollup(rows)
    series = metrics.series(whole, "minute", 24, 10, T0 + dt.timedelta(hours=1)).collect()
    assert [(r.bucket.minute, r.total, r.parsed, r.partial, r.failed) for r in series] == [(20, 2, 2, 0, 0), (21, 1, 0, 1, 0), (22, 1, 0, 0, 1)]
    batch = rows.where("raw like '%x=1%'")
    again = metrics.refreshed_rollup(metrics.minute_rollup(rows.subtract(batch)), rows, batch)
    assert sorted(again.collect()) == sorted(whole.select(again.columns).collect())
    assert metrics.overview(metrics.series(whole, "minute", 24, 10, T0)).first().success_rate == "50.0"
    assert metrics.overview(metrics.series(whole.limit(0), "minute", 24, 10, T0)).first().success_rate == "-"


def test_joins(spark):
    rows = events(spark, SOME)
    devices = spark.createDataFrame([("device-a", "A", "192.168.0.1", "UDP", 514, True), ("off", "B", "192.168.0.2", "UDP", 514, False)], "id string, name string, host string, protocol string, port int, enabled boolean")
    assert joins.backfill_devices(rows, devices).where("device_id = 'device-a'").count() == 2
    rules = spark.createDataFrame([(1, "2.0.0.0/8", "CampusNet", True, False), (0, "2.61.0.0/16", "off", False, False)], "rule_order int, cidr string, name string, enabled boolean, deleted boolean")
    ranges = spark.createDataFrame([(net.number_of("211.120.0.0"), net.number_of("211.120.255.255"), "中国|江苏|南京|联通|CN"), (net.number_of("64.0.0.0"), net.number_of("127.255.255.255"), "X|0|0|Y")], "ip_from long, ip_to long, region string")
    ips = spark.createDataFrame([("2.61.17.9",), ("211.120.5.31",), ("65.1.1.1",), ("10.0.0.1",), ("bad",), (None,)], "ip string")
    assert {tuple(r) for r in joins.address_regions(ips, rules, ranges).collect()} == {("2.61.17.9", "CampusNet"), ("211.120.5.31", "中国|江苏|南京|联通"), ("65.1.1.1", "X|Y")}


def test_text_gzip_and_archives(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_bytes(b"one\r\n\ntwo\n")
    (logs / "b.log.gz").write_bytes(gzip.compress(b"three, long enough to be read\n"))
    (logs / "read me.txt").write_text("no")
    assert {r.raw for r in files.text_logs(spark, str(logs), T0).collect()} == {"one", "two", "three, long enough to be read"}
    cold = tmp_path / "cold"
    cold.mkdir()
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, data in (("logs/plain.log", (FULL + "\n").encode()), ("logs/x.gz", gzip.compress(b"src=1.1.1.1\n"))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (cold / "raw-import-20260425-a.tar.zst").write_bytes(zstandard.compress(tar.getvalue()))
    (cold / "raw-import-20260426-b.raw.zst").write_bytes(zstandard.compress((FULL + "\n").encode()))
    found = files.frozen_events(spark, str(cold)).select("source_addr", "parse_status").collect()
    assert len(found) == 3 and ("frozen://logs/plain.log", "parsed") in {tuple(r) for r in found}
    assert files.frozen_events(spark, str(cold), keyword="dst").count() == 2
    index = files.index_rows(files.frozen_lines(spark, str(cold))).collect()
    assert {(r.day, r.line_count) for r in index} == {("2026-04-25", 2), ("2026-04-26", 1)}
    assert files.archives(spark, str(cold)).count() == 2


def test_sinks_round_trip(spark, tmp_path):
    rows = events(spark, SOME).persist()
    hot = str(tmp_path / "hot")
    assert (sinks.append_events(rows.unionByName(rows), hot), sinks.append_events(rows, hot)) == (4, 0)
    stored = spark.read.parquet(hot)
    sinks.replace_events(files.reparsed(stored.select(EVENT_COLUMNS)).select(EVENT_COLUMNS), hot, 4)
    assert spark.read.parquet(hot).count() == 4
    with pytest.raises(ValueError):
        sinks.replace_events(rows.limit(1), hot, 4)
    with pytest.raises(ValueError):
        files.reparsed(search.without_raw(rows))
    assert sinks.write_frozen(rows, str(tmp_path / "frozen")) >= 1
    assert {r.raw for r in files.frozen_lines(spark, str(tmp_path / "frozen")).collect()} == {r[2] for r in SOME}
    sinks.write_slim(rows, str(tmp_path / "slim"))
    back = files.parquet_events(spark, str(tmp_path / "slim"))
    assert back.select("event_id").distinct().count() == 4
    assert [sinks.export(rows, str(tmp_path / f"out-{k}"), k) for k in ("csv", "csv.zst", "parquet")] == [4, 4, 4]
    assert files.csv_events(spark, str(tmp_path / "out-csv")).count() == 4
    text = zstandard.ZstdDecompressor().stream_reader((tmp_path / "out-csv.zst/export.csv.zst").read_bytes(), read_across_frames=True).read()
    assert text.count(b"\n") == 5
    assert [sinks.publish_state({"rules": rows}, str(tmp_path / "state")) for _ in range(2)] == [1, 2]
    assert sinks.state(spark, str(tmp_path / "state"), "rules").count() == 4


def test_tiers_and_lifecycle(spark):
    rows = events(spark, SOME).persist()
    found = search.tiered(search.Search(limit=3), rows.limit(1), rows.withColumn("path", F.lit("a.parquet"))).collect()
    assert len(found) == 3 and found[0].result_source == "hot"
    deduped = search.tiered(search.Search(include_failed=True), rows, rows.withColumn("path", F.lit("a")), dedup=True)
    assert deduped.count() == 4 and deduped.where("result_source <> 'hot'").count() == 0
    assert lifecycle.compacted(rows, days=1, as_of=T0 + dt.timedelta(days=2)).count() == 0
    old = spark.createDataFrame([("a", 1, T0, "parquet"), ("b", 1, T0, "frozen")], "path string, bytes long, mtime timestamp, category string")
    assert [r.path for r in lifecycle.expired(old, T0 + dt.timedelta(days=200)).collect()] == ["a"]

    def broken():
        raise RuntimeError("x")

    assert lifecycle.cycle([("archive", broken), ("lifecycle", lambda: None)]) == {"archive": "failed: x", "lifecycle": "ok"}


def test_spool_and_streaming(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    (spool / "1.sealed").write_text("\n".join(json.dumps({"offset": i, "ingest_time": "2026-05-16T01:20:00Z", "source_addr": "udp://a:1", "raw": x}) for i, x in enumerate("abc", 1)))
    assert [r.raw for r in files.spool(spark, str(spool), 2).collect()] == ["c"]
    feed = tmp_path / "feed"
    feed.mkdir()
    line = lambda s, raw: json.dumps({"ingest_time": (T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ"), "source_addr": "udp://a:1", "raw": raw})
    hot, rollup = str(tmp_path / "hot"), str(tmp_path / "rollup")

    def run():
        made = stream.event_stream(stream.line_stream(spark, str(feed)))
        stream.start(made, hot, str(tmp_path / "check"), rollup=rollup).awaitTermination()

    (feed / "1.json").write_text("\n".join([line(0, FULL), line(0, FULL), line(65, "src=1.1.1.1")]))
    run()
    (feed / "2.json").write_text("\n".join([line(0, FULL), line(5, FULL + " late=1")]))
    run()
    stored = spark.read.parquet(hot)
    assert stored.count() == 3
    want = metrics.minute_rollup(stored)
    assert sorted(map(tuple, spark.read.parquet(rollup).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert stream.sync(stored.select(EVENT_COLUMNS), str(tmp_path / "copy")) == 3
    assert stream.sync(stored.select(EVENT_COLUMNS), str(tmp_path / "copy")) == 0
