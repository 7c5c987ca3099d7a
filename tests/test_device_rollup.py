"""The device rollup counts every source."""

import datetime as dt

from siftline.plans import queries

T0 = dt.datetime(2026, 5, 16, 1, 20, 1)


def test_device_rollup_has_no_cap(spark, monkeypatch):
    rows = [(T0, f"udp://10.9.{i // 250}.{i % 250}:514", "UDP", "allow", "parsed", 2, 10) for i in range(1100)] + [(T0, "tcp://10.0.0.2:1514", "TCP", "allow", "parsed", 1, 7)]
    kind = "bucket_minute timestamp, source_addr string, protocol string, action string, parse_status string, total_count long, raw_bytes long"
    monkeypatch.setattr(queries, "rollup", lambda *_: spark.createDataFrame(rows, kind))
    got = queries.device_rollup(spark, "").collect()
    assert [(r.kind, r.total, r.raw_bytes) for r in got if r.device == "fw-2"] == [("managed", 1, 7)]
    assert sum(r.kind == "observed" for r in got) == 1100
