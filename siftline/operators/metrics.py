"""Rollups and the series, summaries and calendars read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.search import METRIC_HOURS, clamp

KEYS = ["bucket_minute", "source_addr", "protocol", "action", "parse_status"]


def filled(column, empty: str, change=lambda c: c) -> Column:
    return F.coalesce(change(F.nullif(F.col(column), F.lit(""))), F.lit(empty))


def minute_rollup(events: DataFrame, octets: bool = False) -> DataFrame:
    """Counts and raw sizes by minute, source, protocol, action and status. Partial sums
    before the shuffle keep a busy source from one task."""
    size = F.octet_length("raw") if octets else F.length("raw")
    return events.groupBy(
        F.date_trunc("minute", "ingest_time").alias("bucket_minute"),
        filled("source_addr", "unknown").alias("source_addr"),
        filled("protocol", "UNKNOWN", F.upper).alias("protocol"),
        filled("action", "unknown", F.lower).alias("action"),
        "parse_status",
    ).agg(F.count("*").alias("total_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("raw_bytes"))


def refreshed_rollup(rollup: DataFrame, events: DataFrame, batch: DataFrame) -> DataFrame:
    """The rollup after ``batch`` was added to ``events``: only the minutes that the batch
    touches are counted anew."""
    touched = batch.select(F.date_trunc("minute", "ingest_time").alias("bucket_minute")).distinct()
    minute = F.date_trunc("minute", "ingest_time")
    again = events.withColumn("bucket_minute", minute).join(touched, "bucket_minute", "left_semi").drop("bucket_minute")
    return rollup.join(touched, "bucket_minute", "left_anti").unionByName(minute_rollup(again))


def status_sums(total: Column | None = None) -> list[Column]:
    n = F.lit(1) if total is None else total
    out = [F.sum(n).cast("long").alias("total")]
    return out + [F.coalesce(F.sum(F.when(F.col("parse_status") == s, n)), F.lit(0)).cast("long").alias(s) for s in ("parsed", "partial", "failed")]


def series(rollup: DataFrame, unit: str, hours: int, limit: int, as_of) -> DataFrame:
    """Per minute or hour of the last ``hours``: total, parsed, partial, failed, raw_bytes;
    the newest ``limit``, oldest first."""
    start = F.date_trunc("minute", F.lit(as_of).cast("timestamp")) - F.expr(f"interval {clamp(hours, METRIC_HOURS)} hours")
    rows = rollup.where(F.col("bucket_minute") >= start).groupBy(F.date_trunc(unit, "bucket_minute").alias("bucket"))
    rows = rows.agg(*status_sums(F.col("total_count")), F.sum("raw_bytes").cast("long").alias("raw_bytes"))
    return rows.orderBy(F.desc("bucket")).limit(limit).orderBy("bucket")


def source_totals(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("source_addr").agg(
        *status_sums(F.col("total_count")), F.sum("raw_bytes").cast("long").alias("raw_bytes"), F.max("bucket_minute").alias("last_seen")
    )


def source_top(rollup: DataFrame, limit: int) -> DataFrame:
    return source_totals(rollup).orderBy(F.desc("total"), "source_addr").limit(limit)


def event_stats(events: DataFrame) -> DataFrame:
    return events.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in zip(status_sums(), ("total", "parsed", "partial", "failed"))])


def parse_errors(events: DataFrame, newest: int = 10_000) -> DataFrame:
    """Reasons of the failures among the newest events."""
    rows = events.orderBy(F.desc("ingest_time"), F.desc("event_id")).limit(newest).where("parse_status = 'failed'")
    return rows.groupBy(F.coalesce("parse_error", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n")).orderBy("reason")


def history_view(events: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """History rollups: count, octets and last time by hour or minute and keys."""
    bucket = F.date_trunc(unit, "ingest_time").alias("bucket")
    columns = [F.coalesce(k, F.lit("")).alias(k) for k in keys]
    return events.groupBy(bucket, *columns).agg(
        F.count("*").alias("total_count"), F.sum(F.octet_length("raw")).cast("long").alias("raw_bytes"), F.max("ingest_time").alias("last_seen")
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial aggregates added up: sums of sums, the latest of the last times."""
    return parts.groupBy(*keys).agg(F.sum("total_count").alias("total_count"), F.sum("raw_bytes").alias("raw_bytes"), F.max("last_seen").alias("last_seen"))


def overview(minutes: DataFrame) -> DataFrame:
    """Total, failed, success rate in percent ('-' without events) and the peak of the
    last 96 buckets."""
    last = minutes.orderBy(F.desc("bucket")).limit(96).agg(F.coalesce(F.max("total"), F.lit(0)).alias("peak"))
    sums = minutes.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"))
    rate = F.when(F.col("total") > 0, F.format_string("%.1f", F.floor(F.lit(1000) * F.col("parsed") / F.col("total") + 0.5) / 10)).otherwise("-")
    one = F.lit(1).alias("one")
    joined = sums.select(one, "total", "failed", rate.alias("success_rate")).join(last.select(one, "peak"), "one")
    return joined.select("total", "failed", "success_rate", "peak")


def failing_sources(top: DataFrame, limit: int = 8) -> DataFrame:
    return top.where("failed > 0").orderBy(F.desc("total"), "source_addr").limit(limit)


def action_facets(*tiers: DataFrame) -> DataFrame:
    rows = [t.select(F.lower("action").alias("action")) for t in tiers]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.where("action is not null and action <> ''").distinct()


def days_in(text: Column) -> Column:
    """Valid dates written as yyyymmdd or yyyy-mm-dd in a text: array<date>."""
    found = F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2}-?[01][0-9]-?[0-3][0-9])"), F.lit(1))
    dates = F.transform(found, lambda x: F.to_date(F.try_to_timestamp(F.regexp_replace(x, "-", ""), F.lit("yyyyMMdd"))))
    return F.array_distinct(F.array_compact(dates))


def log_days(rows: DataFrame, column: str = "raw") -> DataFrame:
    return rows.select(F.explode(days_in(F.col(column))).alias("day")).distinct()


def latest_index(index: DataFrame) -> DataFrame:
    """The last index row of each archive."""
    rows = index.groupBy("archive_path").agg(F.max_by(F.struct(*[c for c in index.columns if c != "archive_path"]), "indexed_at").alias("row"))
    return rows.select("archive_path", "row.*")


def index_by_day(index: DataFrame, day=None, limit: int = 10_000) -> DataFrame:
    rows = latest_index(index)
    rows = rows if day is None else rows.where(F.col("day") == F.lit(day))
    return rows.orderBy(F.desc("day"), "archive_path").limit(clamp(limit, 10_000))


def archive_days(index: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct days, newest first, that the archive index (day) or the names of archive
    files (path) tell; unknown ones are left out."""
    named = files.select(F.explode(days_in(F.regexp_extract("path", "([^/]*)$", 1)).cast("array<string>")).alias("day"))
    return index.select("day").union(named).where("day is not null and day <> 'unknown'").distinct().orderBy(F.desc("day"))


def storage_stats(files: DataFrame, hot: DataFrame, history: DataFrame) -> DataFrame:
    """(tier, files, bytes, rows): archives by category, and the rows of stored tables."""
    kept = files.groupBy(F.col("category").alias("tier")).agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    none = F.lit(None).cast("long")
    counted = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("tier"), none.alias("files"), none.alias("bytes"), "rows") for n, t in (("hot", hot), ("history", history))]
    return kept.withColumn("rows", none).unionByName(counted[0]).unionByName(counted[1])


def batch_counters(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for a batch: received, stored (ids that were not there), replayed (the
    rest), and parsed among the stored ones."""
    fresh = batch.groupBy("event_id").agg(F.count("*").alias("n"), F.max((F.col("parse_status") == "parsed").cast("long")).alias("ok"))
    fresh = fresh.join(stored.select("event_id", F.lit(1).alias("there")).dropDuplicates(["event_id"]), "event_id", "left")
    new = F.col("there").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = fresh.agg(total("n").alias("received"), total(new.cast("long")).alias("stored"), total(F.when(new, F.col("ok"))).alias("parsed"))
    return row.select("received", "stored", (F.col("received") - F.col("stored")).alias("replayed"), "parsed")
