"""Archives, copies, rollups, spools and quarantine: cuts, replays, late rows, lost writers."""

import datetime as dt
import json
import struct
import threading

import pytest
import zstandard
from pyspark.sql import functions as F

from siftline.operators import cold, learn, metrics, parse, quarantine, search
from siftline.operators.search import Search
from siftline.schema import EVENT_COLUMNS
from siftline.sources import archives, files, rollups, sinks
from siftline.streaming import spool, stream

T0 = dt.datetime(2026, 2, 3, 4, 5, 6)


def events(spark, rows, **more):
    lines = [(T0 + dt.timedelta(seconds=s), source, raw) for s, source, raw in rows]
    return parse.parse_events(spark.createDataFrame(lines, "ingest_time timestamp, source_addr string, raw string"), **more)


def line(n, dst="9.9.9.9"):
    return f"src=10.9.8.7 dst={dst} proto=6 action=deny n={n}"


# ---------------------------------------------------------------- archives


def multi(path, texts, table=False, **how):
    packer = zstandard.ZstdCompressor(**how)
    packed = [packer.compress(t.encode()) for t in texts]
    tail = archives.table_of([(len(p), len(t.encode())) for p, t in zip(packed, texts)]) if table else b""
    path.write_bytes(b"".join(packed) + tail)


@pytest.mark.parametrize("table", [True, False])
def test_one_archive_of_three_frames_is_read_by_three_tasks(spark, tmp_path, table):
    texts = ["one\ntw", "o\r\n\nthree é", "\nfour\nfive"]
    multi(tmp_path / "a.raw.zst", texts, table, write_checksum=True)
    rows = archives.frozen_scan(spark, str(tmp_path), task_bytes=1)
    assert rows.rdd.getNumPartitions() == 3
    assert [r.raw for r in rows.orderBy("line_no").collect()] == ["one", "two", "three é", "four", "five"]
    assert [r.raw for r in archives.frozen_scan(spark, str(tmp_path)).orderBy("line_no").collect()] == ["one", "two", "three é", "four", "five"]
    parts = archives.frame_index(spark.createDataFrame([(str(tmp_path / "a.raw.zst"),)], "path string"))
    assert sorted(r.raw for r in archives.indexed_lines(parts).collect()) == sorted(["one", "two", "three é", "four", "five"])


def test_lines_meet_frames_anywhere(tmp_path):
    text = "".join(f"{'x' * (i % 7)}{i}\n" for i in range(60)) + "last"
    for cuts in [(1, 2, 3), (5, 50, 51), (10, 11, 200), (30, 31, len(text) - 1)]:
        edges = [0, *cuts, len(text)]
        path = tmp_path / f"{cuts[0]}-{cuts[1]}.raw.zst"
        multi(path, [text[a:b] for a, b in zip(edges[:-1], edges[1:])], table=cuts[0] == 5)
        for most in (1, 60, 1 << 20):
            got = [raw for part in archives.parts_of(str(path), most=most) for b in archives.read_part(part) for raw in b.column("raw").to_pylist()]
            assert got == text.split("\n"), (cuts, most)
    assert len(archives.frames_of(str(path))) == 4
    big = tmp_path / "big.raw.zst"
    multi(big, ["".join(f"{i * 7919 % 10007}\n" for i in range(200_000))] * 2)
    assert len(archives.frames_of(str(big))) == 2 and sum(n for _, n in archives.frames_of(str(big))) == big.stat().st_size
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(b"no archive at all")
        archives.frames_of(str(tmp_path / "bad"))


def test_days_of_names_prune_before_reading(spark, tmp_path):
    multi(tmp_path / "raw-20260203-a.raw.zst", ["kept\n"])
    (tmp_path / "raw-2026-02-04-b.raw.zst").write_bytes(b"broken")
    assert [r.raw for r in files.frozen_lines(spark, str(tmp_path), "2026-02-03").collect()] == ["kept"]


def test_a_cold_search_leaves_what_is_behind_its_limit(spark, tmp_path):
    rows = events(spark, [(86400 * d + n, "udp://a:1", line(f"{d}-{n}")) for d in range(4) for n in range(5)])
    day = F.date_format("ingest_time", "yyyyMMdd")
    archives.freeze(rows, str(tmp_path / "cold"), day, lines=2).collect()
    (tmp_path / "cold" / "raw-20270101.raw.zst").write_bytes(b"broken")
    found = cold.cold_search(spark, Search(keyword="action=deny", limit=7), frozen=str(tmp_path / "cold"), batch=1)
    assert found.report().collect()[0] == (5, 7, 7, True) and found.opened == 3  # one, then two
    assert {r.raw for r in found.events.collect()} == {line(f"0-{n}") for n in range(5)} | {line("1-0"), line("1-1")}
    found = cold.cold_search(spark, Search(keyword="n=2-", limit=50, day="2026-02-05"), frozen=str(tmp_path / "cold"))
    assert found.report().collect()[0] == (1, 5, 5, False)
    # Parquet archives come first; an index names the frozen ones of a day
    (tmp_path / "cold" / "raw-20270101.raw.zst").unlink()
    sinks.write_events(rows.where(day == "20260203").select(EVENT_COLUMNS).coalesce(1), str(tmp_path / "warm"))
    found = cold.cold_search(spark, Search(limit=8), str(tmp_path / "warm"), str(tmp_path / "cold"), batch=1)
    assert [r.result_source for r in found.events.orderBy("result_source", "place").collect()] == ["frozen"] * 3 + ["parquet"] * 5
    assert (found.scanned, found.limited) == (3, True)
    index = spark.createDataFrame([(str(tmp_path / "cold" / "raw-20260206.raw.zst"), "2026-02-06", "udp://a:1")], "archive_path string, day string, source_addr string")
    listed = cold.cold_search(spark, Search(day="20260206", limit=9, device="udp"), frozen=str(tmp_path / "cold"), index=index)
    assert (listed.files, listed.scanned) == (1, 5)
    nothing = cold.cold_search(spark, Search(), frozen=str(tmp_path / "none"))
    assert nothing.report().collect()[0] == (0, 0, 0, False) and nothing.events.collect() == []


def test_an_index_prunes_the_scan(spark, tmp_path):
    rows = events(spark, [(86400 * d + n, f"udp://10.0.0.{d}:514", line(n, f"9.9.{d}.{n}")) for d in range(6) for n in range(4)])
    rows.withColumn("archive", F.date_format("ingest_time", "yyyyMMdd")).write.partitionBy("archive").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    cold.archive_index(table).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    for what, archives_left in ((Search(dst_ip="9.9.3.2"), 1), (Search(device="10.0.0.5"), 1), (Search(date_from="2026-02-04", date_to="2026-02-05"), 2), (Search(dst_ip="1.2.3.4"), 0)):
        assert cold.may_hold(index, what).count() == archives_left
        got = cold.indexed_search(table, index, what)
        assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in search.search_hot(rows, what).collect())
        assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_exports_are_packed_by_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text")).repartition(6)
    n, size, frames = archives.write_zst(rows, [F.desc("id")], F.col("text"), str(tmp_path / "out" / "x.csv.zst"), "head\n", lines=700)
    data = (tmp_path / "out" / "x.csv.zst").read_bytes()
    assert (n, size) == (5000, len(data)) and frames > 7
    text = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read().decode()
    assert text.split("\n") == ["head", *(f"row {i}" for i in range(4999, -1, -1)), ""]
    assert struct.unpack("<I", data[-4:])[0] == archives.SEEKABLE
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["x.csv.zst"]


# ---------------------------------------------------------------- copies and rollups


def test_sync_copies_each_row_once(spark, tmp_path):
    hot, copy = str(tmp_path / "hot"), str(tmp_path / "copy")
    same = events(spark, [(0, "udp://a:1", line(n)) for n in range(9)] + [(1, "udp://a:1", line("x"))])
    sinks.append_events(same, hot)
    read = lambda: spark.read.parquet(hot).select(EVENT_COLUMNS)
    assert stream.sync(read(), copy, limit=4) == 10  # equal times at pages' ends
    assert stream.sync(read(), copy, limit=4) == 0
    late = events(spark, [(-86400 * 40, "udp://a:1", line("late")), (0, "udp://a:1", line("same second")), (5, "udp://a:1", line("new"))])
    sinks.append_events(late, hot)
    assert stream.sync(read().unionByName(read()), copy, late=None, limit=2) == 3
    assert spark.read.parquet(copy).count() == spark.read.parquet(copy).select("event_id").distinct().count() == 13
    page = search.oldest(read(), (T0, ""), 3).collect()
    rest = search.oldest(read(), (page[-1].ingest_time, page[-1].event_id), 100).collect()
    assert len(page) + len(rest) == read().where(F.col("ingest_time") >= F.lit(T0)).count()


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_rollups_by_deltas(spark, tmp_path):
    hot, kept = str(tmp_path / "hot"), rollups.Rollups(spark, str(tmp_path / "r"))
    first = events(spark, [(60 * n, "udp://a:1", line(n)) for n in range(5)] * 2)
    assert rollups.insert_with_rollup(first, hot, kept, "a") == 5
    assert rollups.insert_with_rollup(first, hot, kept, "a") == 0  # replayed
    kept.add("b", events(spark, [(0, "udp://a:1", line("cut")), (60, "udp://a:1", line("off"))]))  # its rows were not stored
    more = events(spark, [(0, "udp://a:1", line("cut")), (60, "udp://a:1", line("off"))])
    assert rollups.insert_with_rollup(more, hot, kept, "b") == 2
    stored = lambda: metrics.minute_rollup(spark.read.parquet(hot).drop("ingest_day"))
    assert rows_of(kept.rows()) == rows_of(stored())
    touched = spark.read.parquet(str(tmp_path / "r" / "parts" / "b"))
    assert touched.select("bucket_minute").distinct().count() == 2
    assert kept.compact() == 1 and kept.compact() is None and rows_of(kept.rows()) == rows_of(stored())
    rollups.insert_with_rollup(events(spark, [(86400 * 3, "udp://b:1", "nothing")]), hot, kept, "c")
    # another writer claimed the next version and went away: nothing is lost
    assert rollups.put_if_absent(spark, f"{tmp_path}/r/claims/{2:012d}") and kept.compact() is None
    assert rows_of(kept.rows()) == rows_of(stored())
    (tmp_path / "r" / "claims" / f"{2:012d}").unlink()
    assert kept.compact() == 2 and kept.manifest()["days"] == {"2026-02-03": 1, "2026-02-06": 2}
    assert kept.vacuum() and rows_of(kept.rows()) == rows_of(stored())
    assert rollups.insert_with_rollup(first, hot, kept, "a") == 0 and rows_of(kept.rows()) == rows_of(stored())
    # a replacement takes the old rows' share away
    old = spark.read.parquet(hot).where("raw = 'nothing'")
    kept.add("d", events(spark, [(86400 * 3, "udp://b:1", line("something"))]), old)
    whole = spark.read.parquet(hot).where("raw <> 'nothing'").select(EVENT_COLUMNS).unionByName(events(spark, [(86400 * 3, "udp://b:1", line("something"))]).select(EVENT_COLUMNS))
    assert rows_of(kept.rows()) == rows_of(metrics.minute_rollup(whole))


def test_history_views_know_a_new_checkpoint(spark, tmp_path):
    history, views = str(tmp_path / "h"), str(tmp_path / "v")
    for k in range(2):  # batches are numbered from 0 again
        folder = tmp_path / f"in{k}"
        events(spark, [(60 * n, "udp://a:1", line(f"{k}-{n}")) for n in range(3 + k)]).write.parquet(str(folder))
        found = spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))
        query = found.writeStream.foreachBatch(stream.history_batch(history, views)).option("checkpointLocation", str(tmp_path / f"c{k}"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(history).count() == 7
    assert stream.stored_view(spark, views, "source").agg(F.sum("total_count")).first()[0] == 7


def test_two_writers_of_state(spark, tmp_path):
    root, got = str(tmp_path / "state"), []
    table = lambda n: spark.range(n).toDF("id")
    writers = [threading.Thread(target=lambda n=n: got.append((n, sinks.publish_state({"rules": table(n)}, root)))) for n in (3, 5, 7)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(v for _, v in got) == [1, 2, 3]
    for n, version in got:
        assert spark.read.parquet(f"{root}/version={version}/rules").count() == n
    assert [(r.version, r.n) for r in sinks.state_versions(spark, root).collect()] == sorted(((v, n) for n, v in got), reverse=True)


# ---------------------------------------------------------------- spool


def segment(folder, name, records):
    text = "".join(json.dumps({"offset": n, "ingest_time": f"2026-02-03T04:05:{n:02d}Z", "source_addr": "udp://a:1", "raw": raw}) + "\n" for n, raw in records)
    (folder / name).write_text(text)


def test_a_spool_is_stored_once_and_committed_after(spark, tmp_path):
    folder, hot = tmp_path / "spool", str(tmp_path / "hot")
    folder.mkdir()
    segment(folder, "seg-1.sealed", [(0, line(1)), (1, line(2))])
    segment(folder, "seg-2.open", [(0, line(3))])
    (folder / "seg-2.open").open("a").write('{"offset": 1, "ingest_t')  # half a record

    def run(store):
        query = spool.spool_stream(spark, str(folder)).writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def broken(batch, number):
        stream.store_batch(hot)(batch, number)
        raise RuntimeError("killed between the store and the commit")

    with pytest.raises(Exception, match="killed"):
        run(broken)
    assert {p.name for p in folder.iterdir()} == {"seg-1.sealed", "seg-2.open"} and spark.read.parquet(hot).count() == 3
    run(stream.store_batch(hot))
    segment(folder, "seg-2.open", [(0, line(3)), (1, line(4))])
    (folder / "seg-2.open").rename(folder / "seg-2.sealed")
    segment(folder, "seg-3.open", [(0, line(5))])
    run(stream.store_batch(hot))
    segment(folder, "seg-3.open", [(0, line(5)), (1, line(6))])
    run(stream.store_batch(hot))
    stored = spark.read.parquet(hot)
    assert sorted(r.raw for r in stored.collect()) == [line(n) for n in range(1, 7)]
    assert (folder / "seg-1.committed").exists() and (folder / "seg-2.committed").exists() and (folder / "seg-3.open").exists()
    assert spool.cleanup(str(folder)) == 2 and [p.name for p in folder.iterdir()] == ["seg-3.open"]


# ---------------------------------------------------------------- quarantine, state


def test_holds_double_and_recover_by_stages(spark):
    minute = lambda *at: [("s", T0.replace(second=0) + dt.timedelta(minutes=m), True) for m in at]
    rows = spark.createDataFrame(minute(0, 3, 12, 40, 400) + [("t", T0, False)], "scope_key string, bucket timestamp, trouble boolean")
    got = quarantine.quarantine(rows).orderBy("start").collect()
    begin = T0.replace(second=0)
    at = lambda t: (t - begin).total_seconds() / 60
    # held 10 minutes from the end of minute 0; minute 3 changes nothing; minute 12 ends in the first stage
    assert [(at(r.start), at(r.stop), r.share, r.backoff) for r in got] == [
        (1, 11, 0.0, 0), (11, 13, 0.25, 0), (13, 33, 0.0, 1), (33, 38, 0.25, 1), (38, 41, 0.5, 1), (41, 81, 0.0, 2), (81, 86, 0.25, 2), (86, 91, 0.5, 2),
        (401, 411, 0.0, 0), (411, 416, 0.25, 0), (416, 421, 0.5, 0),
    ]
    many = spark.createDataFrame([("s", begin + dt.timedelta(days=2 * d), True) for d in range(1)] + [("s", begin + dt.timedelta(seconds=600 * (2**k - 1) + 60 * k), True) for k in range(1, 12)], rows.schema)
    assert max((r.stop - r.start).total_seconds() for r in quarantine.quarantine(many).collect()) == 86_400
    assert [tuple(r) for r in quarantine.quarantined(quarantine.quarantine(rows), begin + dt.timedelta(minutes=35)).select("scope_key", "share", "backoff").collect()] == [("s", 0.25, 1)]


def test_quarantine_of_a_stream(spark, tmp_path):
    hot, health = str(tmp_path / "hot"), str(tmp_path / "health")
    run = quarantine.quarantine_batch(hot, health, least=4, share=0.5)
    bad = lambda a, b: events(spark, [(n, "udp://10.0.0.1:514", f"nothing {'x' * n}") for n in range(a, b)]).drop("scope_key")
    run(bad(0, 3), 0)
    run(bad(0, 3), 0)
    assert quarantine.stored_quarantine(spark, health).count() == 0  # replayed lines count once
    run(bad(3, 6), 1)
    got = quarantine.stored_quarantine(spark, health)
    assert got.where("share = 0").count() == 1
    rows = spark.createDataFrame([("rule:source:udp://10.0.0.1:actName:action", "source:udp://10.0.0.1", "actName", "action", "action")], "rule_id string, scope_key string, raw_key string, canonical_field string, value_type string")
    for minutes, filled in ((3, 0), (60, 40)):
        lines = events(spark, [(60 * minutes + n % 50, "udp://10.0.0.1:514", f"src=10.1.1.1 dst=9.9.9.9 actName=deny n={n}") for n in range(40)])
        assert quarantine.apply_outside(lines, rows, got).where("action = 'deny'").count() == filled
    lines = events(spark, [(720 + n % 50, "udp://10.0.0.1:514", f"src=10.1.1.1 dst=9.9.9.9 actName=deny n={n}") for n in range(400)])
    assert 40 < quarantine.apply_outside(lines, rows, got).where("action = 'deny'").count() < 180  # a quarter
    # many shapes in one minute are a flood
    flood = quarantine.scope_health(events(spark, [(n % 20, "udp://b:1", "?" * n + " x1 ") for n in range(1, 12)]), most=10, least=100)
    assert flood.first().trouble and flood.first().shapes == 11


def test_profile_deltas_mark_what_they_drop(spark):
    rows = events(spark, [(n, f"udp://10.0.0.{n}:514", line(n)) for n in range(6)], diagnostics=True).coalesce(1)
    whole = learn.profile_deltas(rows)
    assert whole.where("gap").count() == 0 and whole.select("scope_key").distinct().count() == 6
    per_scope = whole.where("scope_key = 'source:udp://10.0.0.0'").count()
    few = learn.profile_deltas(rows, most=per_scope * 2)
    assert 1 <= few.where("not gap").select("scope_key").distinct().count() <= 2
    exact = {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in few.where("not gap").collect()} <= exact


def test_history_filters_and_routing(spark):
    rows = events(spark, [(0, "udp://a:1", line(1)), (1, "udp://a:1", "src=1.1.1.1 proto=6"), (2, "udp://a:1", "nothing")])
    assert search.search_history(rows, Search(keyword="no parser", include_failed=True)).count() == 1
    assert search.search_history(rows, Search()).count() == 1 and search.search_hot(rows, Search()).count() == 2
    empty = rows.limit(0)
    assert search.routed(Search(day="20260203"), empty, rows, T0 + dt.timedelta(days=9)).count() == 1
    assert search.routed(Search(), rows, empty, T0).count() == 2
    assert search.routed(Search(date_from="2026-02-03"), rows, empty, dt.datetime(2026, 2, 3, 0, 30)).count() == 2


def test_listings(spark):
    rows = events(spark, [(n, "not a uri" if n == 2 else f"udp://10.0.0.{n}:514", "nothing" if n else line(n)) for n in range(4)])
    scopes = learn.scope_listing(rows).collect()
    assert [r.unknown_source for r in scopes] == [False, True, False, False] and scopes[0].scope_key == "source:udp://10.0.0.3"
    assert [r.raw_source for r in learn.alias_listing(rows).collect()][0] == "udp://10.0.0.3:514"
    assert learn.diagnostic_listing(rows).first().last_seen == T0 + dt.timedelta(seconds=3)


# ---------------------------------------------------------------- tables and lifecycle


def test_bounds_prune_days_by_event_times(spark, tmp_path):
    from siftline.sources import tables

    rows = events(spark, [(86400 * d, "udp://a:1", line(d)) for d in range(8)])
    tables.store(rows, str(tmp_path / "t"))
    tables.write_bounds(spark, str(tmp_path / "t"))
    what = Search(date_from="2026-02-05", date_to="2026-02-06")
    got = search.search_hot(tables.bounded(spark, str(tmp_path / "t"), what.date_from, what.date_to), what)
    assert sorted(r.raw for r in got.collect()) == [line(2), line(3)]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_an_archive_phase_reads_its_own_files(spark, tmp_path):
    from siftline.operators import lifecycle

    rows = events(spark, [(86400 * d + n, "udp://a:1", line(f"{d}-{n}")) for d in range(2) for n in range(3)])
    warm, frozen = str(tmp_path / "warm"), str(tmp_path / "frozen")
    assert sorted((r.day, r.line_count) for r in lifecycle.archive(rows, warm, frozen, 4).collect()) == [("2026-02-03", 1), ("2026-02-04", 3)]
    for old in (tmp_path / "frozen").glob("*.zst"):
        old.write_bytes(b"broken")  # a later phase doesn't open it
    index, gone = lifecycle.archive_and_retain(rows, warm, frozen, 6, dt.datetime.now())
    assert sorted(r.line_count for r in index.collect()) == [3, 3] and gone == 0
    later = dt.datetime.now() + dt.timedelta(days=200)
    assert lifecycle.delete_files(lifecycle.expired(files.archives(spark, warm), later)) >= 2
    assert files.archives(spark, frozen).count() == 4


def test_raw_is_pruned_on_the_days_that_have_it(spark, tmp_path):
    from siftline.operators import lifecycle

    rows = events(spark, [(0, "udp://a:1", line(1)), (86400, "udp://a:1", "nothing"), (86401, "udp://a:1", "src=1.1.1.1")])
    sinks.append_events(rows, str(tmp_path / "t"))
    assert lifecycle.prune_stored_raw(spark, str(tmp_path / "t")) == 1 and lifecycle.prune_stored_raw(spark, str(tmp_path / "t")) == 0
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["", "nothing", "src=1.1.1.1"]


def test_imports_and_replacements_keep_the_rollup(spark, tmp_path):
    hot, kept = str(tmp_path / "hot"), rollups.Rollups(spark, str(tmp_path / "r"))
    rows = events(spark, [(60 * n, "udp://a:1", line(n)) for n in range(4)]).select(EVENT_COLUMNS)
    sinks.export(rows, str(tmp_path / "csv"), "csv")
    assert rollups.import_csv(spark, str(tmp_path / "csv"), hot, kept, "import-1") == 4
    assert rollups.import_csv(spark, str(tmp_path / "csv"), hot, kept, "import-2") == 0
    assert rows_of(kept.rows()) == rows_of(metrics.minute_rollup(spark.read.parquet(hot)))
    rollups.replace_with_rollup(rows.withColumn("action", F.lit("PERMIT")), hot, kept, 4)
    assert rows_of(kept.rows()) == rows_of(metrics.minute_rollup(spark.read.parquet(hot))) and kept.rows().first().action == "permit"
