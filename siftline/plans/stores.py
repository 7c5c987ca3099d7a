"""Registered queries that write archives, tables and streams and read them back."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import cold, learn, quarantine, search
from siftline.operators.search import Search
from siftline.plans.lines import ARROW, TASK_LINES, lines
from siftline.plans.oracle import EVENT, ROLLUP, TIME
from siftline.plans.queries import _CAND, _GEO, _LEARNED, _NEW, _OK, _SHAPED, _TIER_ORDER, _TIERED_SQL, _TIERS_SQL, _state, _stored, _tiers, cidrs, events, kept_events, ranges, register, shown
from siftline.schema import EVENT_COLUMNS, RAW
from siftline.sources import archives, files, rollups, tables
from siftline.streaming import spool, stream

# ---------------------------------------------------------------- archives

#: an archive is a day and a bucket of the event_id, so that it holds about a million lines
_KEYED = """, n AS (SELECT greatest(1, CAST(ceil(count(*) / 1000000.0) AS INTEGER)) AS b FROM lines),
  keyed AS (SELECT ev.*, strftime(ingest_time, '%Y%m%d') || '-' || printf('%05d', CAST('0x' || substr(event_id, 1, 7) AS INTEGER) % b) AS key FROM ev, n)"""


def _key(n: int) -> Column:
    buckets = max(1, -(-n // 1_000_000))
    bucket = F.conv(F.substring("event_id", 1, 7), 16, 10).cast("int") % buckets
    return F.concat(F.date_format("ingest_time", "yyyyMMdd"), F.lit("-"), F.lpad(bucket.cast("string"), 5, "0"))


def _archived(spark, sf_dir):
    """The events of even days as Parquet archives, the lines of odd days frozen; the paths
    of both and what was frozen."""
    path = tables.scratch(spark, "archives")
    rows, key = _stored(spark, sf_dir), _key(lines(spark, sf_dir).count())
    even = F.dayofmonth("ingest_time") % 2 == 0
    rows.where(even).select(*EVENT_COLUMNS, key.alias("archive")).repartition("archive").write.partitionBy("archive").parquet(f"{path}/events")
    return f"{path}/events", f"{path}/frozen", archives.freeze(rows.where(~even), f"{path}/frozen", key)


_COLD_WHAT = Search(dst_ip="8.8.8.8", protocol="17", action="ALLOW", limit=150)
_COLD_SQL = _KEYED + f""", fits AS (SELECT *, coalesce(dst_ip = '8.8.8.8' AND upper(protocol) = 'UDP' AND lower(action) = 'allow' AND {_OK}, false) AS hit, day(ingest_time) % 2 = 0 AS warm FROM keyed),
  w AS (SELECT raw, row_number() OVER (ORDER BY key, ingest_time DESC, event_id DESC) AS r FROM fits WHERE warm AND hit),
  placed AS (SELECT *, row_number() OVER (ORDER BY key, ingest_time, event_id) AS place FROM fits WHERE NOT warm),
  c AS (SELECT raw, place, row_number() OVER (ORDER BY place) AS r FROM placed WHERE hit),
  nw AS (SELECT least(count(*), 150) AS n FROM w), nc AS (SELECT least(count(*), 150 - min(nw.n)) AS n FROM c, nw)
"""


def _cold(spark, sf_dir):
    warm, frozen, _ = _archived(spark, sf_dir)
    return cold.cold_search(spark, _COLD_WHAT, warm, frozen, rules=[ARROW])


@register(_COLD_SQL + """ SELECT (SELECT count(DISTINCT key) FROM keyed) AS files, nw.n + nc.n AS matched, nw.n + nc.n >= 150 AS limited,
    CASE WHEN nw.n >= 150 THEN 0 WHEN nw.n + nc.n >= 150 THEN (SELECT max(place) FROM c WHERE r <= nc.n) ELSE (SELECT count(*) FROM placed) END AS scanned_lines FROM nw, nc""")
def cold_search_report(spark, sf_dir):
    """A search of written archives until its limit, and what it took."""
    return _cold(spark, sf_dir).report()


@register(_COLD_SQL + " SELECT raw, 'parquet' AS result_source FROM w, nw WHERE r <= nw.n UNION ALL SELECT raw, 'frozen' FROM c, nc WHERE r <= nc.n")
def cold_search_events(spark, sf_dir):
    return _cold(spark, sf_dir).events.select("raw", "result_source")


@register(_KEYED + " SELECT CASE WHEN day(ingest_time) % 2 = 0 THEN 'parquet' ELSE 'frozen' END AS category, count(DISTINCT key) AS files FROM keyed GROUP BY 1")
def archive_listing(spark, sf_dir):
    """The files of written archives, as they are found on disk."""
    warm, frozen, written = _archived(spark, sf_dir)
    written.count()
    return files.archives(spark, warm).unionByName(files.archives(spark, frozen)).groupBy("category").agg(F.count("*").alias("files"))


@register(_KEYED + " SELECT raw, CAST(CAST(ingest_time AS DATE) AS VARCHAR) AS day FROM keyed WHERE day(ingest_time) % 2 = 1")
def frozen_round_trip(spark, sf_dir):
    """Lines that were frozen frame by frame and read by many tasks."""
    _, frozen, _ = _archived(spark, sf_dir)
    return files.frozen_raw(spark, frozen).select("raw", F.to_date("ingest_time").cast("string").alias("day"))


@register(_KEYED + " SELECT key, count(*) AS line_count, CAST(CAST(min(ingest_time) AS DATE) AS VARCHAR) AS day FROM keyed WHERE day(ingest_time) % 2 = 1 GROUP BY 1")
def archive_index_rows(spark, sf_dir):
    """Index rows of frozen archives, from their lines."""
    _, frozen, _ = _archived(spark, sf_dir)
    return files.index_rows(files.frozen_lines(spark, frozen)).select(F.regexp_extract("archive_path", r"raw-([^/]*)\.raw\.zst$", 1).alias("key"), "line_count", "day")


_INDEXED = Search(date_from="2024-01-12", date_to="2024-01-16", dst_ip="8.8.8.8", device="10.0.0.3", limit=500)


def _indexed_table(spark, sf_dir):
    path = tables.scratch(spark, "indexed")
    rows = _stored(spark, sf_dir).select(*EVENT_COLUMNS, _key(lines(spark, sf_dir).count()).alias("archive"))
    rows.repartition("archive").write.partitionBy("archive").parquet(f"{path}/events")
    table = spark.read.parquet(f"{path}/events")
    cold.archive_index(table).write.parquet(f"{path}/index")
    return table, spark.read.parquet(f"{path}/index")


@register(f""" SELECT {EVENT} FROM ev WHERE dst_ip = '8.8.8.8' AND source_addr LIKE '%10.0.0.3%' AND {_OK} AND CAST(coalesce(event_time, ingest_time) AS DATE) BETWEEN DATE '2024-01-12' AND DATE '2024-01-16'{_NEW}500""")
def indexed_search(spark, sf_dir):
    """A search of a table of archives of which an index leaves a few."""
    return shown(cold.indexed_search(*_indexed_table(spark, sf_dir), _INDEXED).select(EVENT_COLUMNS))


# ---------------------------------------------------------------- history, tiers

_PARSED = "parse_status = 'parsed'"


@register(f" SELECT {EVENT} FROM ev WHERE (raw LIKE '%dst=8.8%' OR coalesce(parse_error, '') LIKE '%dst=8.8%') AND {_PARSED}{_NEW}700")
def history_search(spark, sf_dir):
    return shown(search.search_history(events(spark, sf_dir), Search(keyword="dst=8.8", limit=700)).select(EVENT_COLUMNS))


@register(f" SELECT {EVENT} FROM ev WHERE (raw LIKE '%no parser%' OR coalesce(parse_error, '') LIKE '%no parser%'){_NEW}300")
def routed_search(spark, sf_dir):
    """A search that begins before the hot window: the history answers, where a keyword
    may stand in the parse error."""
    rows = events(spark, sf_dir)
    what = Search(keyword="no parser", include_failed=True, date_from="2023-06-01", limit=300)
    return shown(search.routed(what, rows.where(F.lit(False)), rows, datetime(2024, 12, 31)).select(EVENT_COLUMNS))


@register(
    _TIERS_SQL + ", found AS MATERIALIZED (" + _TIERED_SQL.replace(EVENT, "event_id, src_ip, dst_ip") + " AND source_addr LIKE '%10.0.0.%'" + _TIER_ORDER + "2000)"
    + _GEO.replace("found AS (SELECT ip", "located AS (SELECT ip")
    + ", reg AS (SELECT ip, coalesce(name, region) AS region FROM named FULL JOIN located USING (ip)) SELECT event_id, result_source, s.region AS src_region, d.region AS dst_region, coalesce(s.region, d.region) AS geo_region FROM found LEFT JOIN reg s ON src_ip = s.ip LEFT JOIN reg d ON dst_ip = d.ip"
)
def unified_search(spark, sf_dir):
    """A search over the tiers, with the regions of what it finds."""
    found = cold.unified(Search(device="10.0.0.", limit=2000), cidrs(spark), ranges(spark), *_tiers(spark, sf_dir))
    return found.select("event_id", "result_source", "src_region", "dst_region", "geo_region")


# ---------------------------------------------------------------- streams and copies


@register(f" SELECT event_id, {TIME('ingest_time')} AS ingest_time, count(*) AS n FROM ev GROUP BY ALL")
def sync_pages(spark, sf_dir):
    """A copy that first holds a third of the rows, early and late ones, then all: pages by
    days, late rows by days whose counts differ."""
    rows, target = _stored(spark, sf_dir), tables.scratch(spark, "copy")
    third = F.conv(F.substring("event_id", 1, 6), 16, 10).cast("int") % 3 == 0
    stream.sync(rows.where(third & (F.col("ingest_time") < F.lit(datetime(2024, 1, 15)))), target)
    for _ in range(2):
        stream.sync(rows, target, late=None)
    return shown(spark.read.parquet(target).groupBy("event_id", "ingest_time").agg(F.count("*").alias("n")))


@register(ROLLUP + f" SELECT {TIME('bucket_minute')} AS bucket_minute, source_addr, protocol, action, parse_status, total_count, raw_bytes FROM rollup")
def rollup_deltas(spark, sf_dir):
    """All lines as a stream; the rollup is kept by deltas and compacted in between."""
    path = tables.scratch(spark, "deltas")
    cores = spark.sparkContext.defaultParallelism
    # as many files, and so batches, however large the table is; a batch's lines are dealt
    # to tasks again, as its few files alone would leave most cores idle
    lines(spark, sf_dir).select("ingest_time", "source_addr", "raw").coalesce(cores).write.parquet(f"{path}/lines")
    from siftline.operators.parse import parse_events

    tasks = max(cores, -(-spark.read.parquet(f"{path}/lines").count() // (2 * TASK_LINES)))
    arriving = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 4).parquet(f"{path}/lines").repartition(tasks)
    found = parse_events(arriving, rules=[ARROW])
    writer = found.writeStream.foreachBatch(rollups.rollup_batch(f"{path}/hot", f"{path}/rollup", every=1))
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shown(rollups.Rollups(spark, f"{path}/rollup").rows())


def _segments(target: str):
    """Rows as spool segments, one for each task."""

    def run(batches):
        import json

        from pyspark import TaskContext

        system, root = archives.located(target)
        system.create_dir(root, recursive=True)
        task, n = TaskContext.get(), 0
        name = f"{root}/seg-{task.partitionId():06d}.sealed"
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            for batch in batches:
                for at, source, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(json.dumps({"offset": n, "ingest_time": at, "source_addr": source, "raw": raw}).encode() + b"\n")
                    n += 1
        system.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


@register(f" SELECT event_id, {TIME('ingest_time')} AS ingest_time, source_addr, parse_status FROM ev")
def spool_replay(spark, sf_dir):
    """All lines as spool segments, streamed to a table by segment and offset."""
    path = tables.scratch(spark, "spooled")
    rows = lines(spark, sf_dir).select(F.date_format("ingest_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), "source_addr", "raw")
    rows.mapInArrow(_segments(f"{path}/spool"), "n long").write.parquet(f"{path}/written")
    query = spool.spool_stream(spark, f"{path}/spool", rules=[ARROW]).writeStream.foreachBatch(stream.store_batch(f"{path}/hot")).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return shown(spark.read.parquet(f"{path}/hot").select("event_id", "ingest_time", "source_addr", "parse_status"))


# ---------------------------------------------------------------- quarantine, state

_HEALTH = _SHAPED + """, health AS (
    SELECT e.scope_key, date_trunc('hour', e.ingest_time) AS bucket, count(*) AS total, count(*) FILTER (e.parse_status = 'failed') AS failed,
      count(DISTINCT f.fingerprint) AS shapes, count(DISTINCT CASE WHEN e.parse_status = 'failed' THEN e.source_addr END) AS sources
    FROM ev e LEFT JOIN failed f USING (line_id) GROUP BY 1, 2),
  bad AS (SELECT scope_key, epoch(bucket + INTERVAL 1 HOUR) AS t, row_number() OVER (PARTITION BY scope_key ORDER BY bucket) AS k
    FROM health WHERE shapes > 200 OR sources > 200 OR (total >= 2 AND failed >= 0.5 * total)),
  run AS (
    SELECT scope_key, k, t, t + 3600 AS until, 0 AS backoff, true AS starts FROM bad WHERE k = 1
    UNION ALL
    SELECT scope_key, k, t, CASE WHEN held THEN until ELSE t + least(3600 * pow(2, again), 86400) END, CASE WHEN held THEN backoff ELSE again END, NOT held
    FROM (SELECT b.scope_key, b.k, b.t, r.until, r.backoff, b.t < r.until AS held, CASE WHEN b.t < r.until + 3600 THEN r.backoff + 1 ELSE 0 END AS again
          FROM run r JOIN bad b ON b.scope_key = r.scope_key AND b.k = r.k + 1)),
  holds AS (SELECT scope_key, t, until, backoff, lead(t) OVER (PARTITION BY scope_key ORDER BY t) AS nxt FROM run WHERE starts),
  spans AS (
    SELECT scope_key, t AS a, until AS b, CAST(0 AS DOUBLE) AS share, backoff FROM holds
    UNION ALL SELECT scope_key, until + i * 1800, least(until + (i + 1) * 1800, coalesce(nxt, 1e18)), CAST(CASE i WHEN 0 THEN 0.25 ELSE 0.5 END AS DOUBLE), backoff
    FROM holds, range(2) AS s(i) WHERE nxt IS NULL OR until + i * 1800 < nxt)"""


def _quarantine(spark, sf_dir, rows: DataFrame | None = None):
    rows = events(spark, sf_dir) if rows is None else rows
    health = quarantine.scope_health(rows, "hour", least=2, share=0.5)
    return quarantine.quarantine(health, "hour", hold=3600, stage=1800)


@register(_HEALTH + f" SELECT scope_key, {TIME('make_timestamp(CAST(a * 1000000 AS BIGINT))')} AS start, {TIME('make_timestamp(CAST(b * 1000000 AS BIGINT))')} AS stop, CAST(share AS DOUBLE) AS share, backoff FROM spans")
def quarantine_intervals(spark, sf_dir):
    """When scopes with too many failures are held and how they recover."""
    return shown(_quarantine(spark, sf_dir))


@register(
    _HEALTH + _CAND + """, shares AS (SELECT line_id, coalesce(min(s.share), 1.0) AS share FROM ev LEFT JOIN spans s ON s.scope_key = ev.scope_key AND epoch(ingest_time) >= a AND epoch(ingest_time) < b GROUP BY 1),
      lucky AS (SELECT line_id FROM cand JOIN rated USING (rule_id) JOIN shares USING (line_id) WHERE n >= 20 AND bound >= 0.8 AND CAST('0x' || substr(sha256(event_id), 1, 4) AS INTEGER) < share * 65536)
    SELECT ev.event_id, CASE WHEN l.line_id IS NOT NULL THEN regexp_extract(raw, 'actName=([^ ]+)', 1) ELSE action END AS action, CASE WHEN l.line_id IS NOT NULL THEN 'parsed' ELSE parse_status END AS parse_status
    FROM ev LEFT JOIN lucky l USING (line_id)"""
)
def quarantine_apply(spark, sf_dir):
    """Learned rules on all events, but for those that a quarantine keeps them from."""
    rows = kept_events(spark, sf_dir, *_LEARNED)
    done = quarantine.apply_outside(rows, learn.active_rules(_state(spark, sf_dir, found=rows)), _quarantine(spark, sf_dir, rows))
    return done.select("event_id", "action", "parse_status")


@register(
    """, a AS (
      SELECT scope_key, 'parser:sangfor_nat_v1' AS parser_id, v_status AS status FROM try JOIN ev USING (line_id)
      UNION ALL SELECT scope_key, 'parser:generic_kv_v1', g_status FROM try JOIN ev USING (line_id) WHERE gated
      UNION ALL SELECT scope_key, 'parser:rule_based_v1', r_status FROM try JOIN ev USING (line_id))
    SELECT scope_key, parser_id, status, count(*) AS n, false AS gap FROM a GROUP BY ALL"""
)
def profile_deltas(spark, sf_dir):
    return learn.profile_deltas(events(spark, sf_dir, diagnostics=True))


@register(f" SELECT scope_key, bool_and(source_addr NOT LIKE '%://%') AS unknown_source, count(*) AS n, {TIME('max(ingest_time)')} AS last_seen FROM ev GROUP BY 1")
def scope_listing(spark, sf_dir):
    return shown(learn.scope_listing(events(spark, sf_dir)))
