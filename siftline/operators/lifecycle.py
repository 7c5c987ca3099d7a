"""Tiering jobs: compaction, archiving, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.search import newest, pruned_raw
from siftline.schema import EVENT_COLUMNS

PARQUET_DAYS, FROZEN_DAYS, HISTORY_DAYS, ROLLUP_DAYS = 180, 365, 90, 30
#: lines of a day's archive, about
ARCHIVE_ROWS = 1_000_000


def compacted(events: DataFrame, newest_rows: int | None = None, any_rows: int | None = None, days: int | None = None, as_of: datetime | None = None, drop_raw: bool = False) -> DataFrame:
    """All events, the newest, any so many, or those of the last days before ``as_of``."""
    if days is not None:
        events = events.where(F.col("ingest_time") >= F.lit(as_of - timedelta(days=days)))
    if newest_rows is not None:
        events = newest(events, newest_rows, most=2**31 - 1)
    elif any_rows is not None:
        events = events.limit(any_rows)
    return pruned_raw(events) if drop_raw else events


def living(rows: DataFrame, as_of: datetime, days: int = HISTORY_DAYS, column: str = "ingest_time") -> DataFrame:
    """What a history table keeps: events of the last HISTORY_DAYS days, or rollups (by
    ``column``) of the last ROLLUP_DAYS; whole days, so that a table partitioned by day
    drops partitions."""
    return rows.where(F.to_date(column) >= F.lit((as_of - timedelta(days=days)).date()))


def report(events: DataFrame, hot_limit: int, output: str) -> DataFrame:
    return events.agg(F.count("*").alias("rows")).select(F.lit(hot_limit).alias("hot_limit"), "rows", F.lit(output).alias("output"))


def expired(files: DataFrame, as_of: datetime) -> DataFrame:
    """Archives past their retention. files: path, bytes, mtime, category."""
    days = F.when(F.col("category") == "parquet", PARQUET_DAYS).otherwise(FROZEN_DAYS)
    return files.where(F.timestamp_diff("DAY", "mtime", F.lit(as_of)) >= days)


def delete_files(files: DataFrame) -> int:
    """Delete the files of a listing, one by one as the driver goes through it."""
    spark = files.sparkSession
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for row in files.select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row["path"])
        n += bool(path.getFileSystem(conf).delete(path, False))
    return n


def archive(events: DataFrame, target: str, frozen: str, limit: int) -> DataFrame:
    """One archive phase: the newest rows, picked once, as Parquet by day and as frozen raw
    lines under a name of this phase; the archive index rows of the files that it wrote,
    found in those files alone."""
    from siftline.sources.archives import frame_index, freeze, indexed_lines
    from siftline.sources.files import index_rows
    from siftline.sources.sinks import write_events
    from siftline.sources.tables import scratch

    spark, picked = events.sparkSession, scratch(events.sparkSession, "picked")
    newest(events, limit, most=2**31 - 1).select(EVENT_COLUMNS).write.parquet(picked)
    rows = spark.read.parquet(picked)
    write_events(rows, target)
    phase = picked.rpartition("-")[2][:8]
    buckets = max(1, -(-limit // ARCHIVE_ROWS))
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("string")
    files = freeze(rows, frozen, F.concat_ws("-", F.date_format("ingest_time", "yyyyMMdd"), F.lit(phase), F.lpad(bucket, 5, "0")))
    return index_rows(indexed_lines(frame_index(files.select("path"))))


def archive_and_retain(events: DataFrame, target: str, frozen: str, limit: int, as_of: datetime) -> tuple[DataFrame, int]:
    """An archive phase, then retention: the new index rows and the number of files gone."""
    from siftline.sources.files import archives

    index = archive(events, target, frozen, limit)
    gone = sum(delete_files(expired(archives(events.sparkSession, path), as_of)) for path in (target, frozen))
    return index, gone


def prune_stored_raw(spark, table: str) -> int:
    """Empty the raw text of parsed rows in a table by ingest_day; the number of days that
    were written again, which are those that had such rows. Others stay as they are."""
    from siftline.sources.tables import scratch

    rows = spark.read.parquet(table)
    full = rows.where("parse_status = 'parsed' and raw <> ''")
    days = [r[0] for r in full.select("ingest_day").distinct().collect()]  # at most one for each day
    if days:
        staged = scratch(spark, "pruned")
        pruned_raw(rows.where(F.col("ingest_day").isin(days))).write.parquet(staged)
        again = spark.read.schema(rows.schema).parquet(staged)
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("ingest_day").parquet(table)
    return len(days)


def cycle(jobs) -> dict[str, str]:
    """Run named jobs in order; a failure is reported and stops none of the others."""
    out = {}
    for name, job in jobs:
        try:
            job()
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001
            out[name] = f"failed: {e}"
    return out
