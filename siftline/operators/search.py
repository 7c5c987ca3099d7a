"""Searches: one set of filters over hot, archived and historical events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.net import protocol_name
from siftline.schema import EVENT_COLUMNS, SLIM_COLUMNS

QUERY_LIMIT, COLD_LIMIT, EXPORT_LIMIT = 100_000, 10_000, 1_000_000
METRIC_HOURS = 8784
#: rows of a limit that each task may send to the one that picks the first of all
TOP_ROWS = 5_000


def clamp(n: int, most: int, least: int = 1) -> int:
    return max(least, min(most, n))


@dataclass
class Search:
    """Filters of a search; blank ones count as absent. A day wins over nothing, a range
    over a day."""

    day: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    device: str | None = None
    device_id: str | None = None
    src_ip: str | None = None
    dst_ip: str | None = None
    protocol: str | None = None
    action: str | None = None
    keyword: str | None = None
    include_failed: bool = False
    scope: str = "all"
    limit: int = 100

    def __post_init__(self):
        for name in ("day", "date_from", "date_to", "device", "device_id", "src_ip", "dst_ip", "protocol", "action", "keyword"):
            value = getattr(self, name)
            setattr(self, name, (value.strip() or None) if value is not None else None)
        if self.scope not in ("hot", "archive", "all"):
            raise ValueError("scope is hot, archive or all")
        if self.date_from and self.date_to:
            span = (date.fromisoformat(self.date_to) - date.fromisoformat(self.date_from)).days
            if span < 0 or span > 366:
                raise ValueError("date_to is before date_from, or more than 366 days after it")
        if self.date_from or self.date_to:
            self.day = None

    def the_day(self) -> date | None:
        digits = "".join(c for c in self.day or "" if c.isdigit())
        if len(digits) != 8:
            return None
        try:
            return date.fromisoformat(f"{digits[:4]}-{digits[4:6]}-{digits[6:]}")
        except ValueError:
            return None


def on_day(column: str, day: date) -> Column:
    """Bounds of the column itself, which reach the Parquet scan; a cast of it would not."""
    return (F.col(column) >= F.lit(day)) & (F.col(column) < F.lit(day + timedelta(days=1)))


def at_or(bound) -> Column:
    """``bound`` of event_time, or of ingest_time where there is none."""
    return bound(F.col("event_time")) | (F.col("event_time").isNull() & bound(F.col("ingest_time")))


def predicates(search: Search, raw: bool = True, history: bool = False) -> list[Column]:
    """The filters as independent conjuncts, on the columns of events. Without ``raw``
    a keyword matches nothing. In the history a keyword may stand in the parse error, too,
    and without failed lines only parsed ones are found."""
    out = []
    if search.device:
        out.append(F.col("source_addr").contains(search.device))
    if search.device_id:
        out.append(F.col("device_id") == search.device_id)
    if day := search.the_day():
        fits = on_day("ingest_time", day) | on_day("event_time", day)
        out.append(fits | F.col("raw").contains(search.day) if raw else fits)
    if search.date_from:
        first = F.lit(date.fromisoformat(search.date_from))
        out.append(at_or(lambda t: t >= first))
    if search.date_to:
        after = F.lit(date.fromisoformat(search.date_to) + timedelta(days=1))
        out.append(at_or(lambda t: t < after))
    for name in ("src_ip", "dst_ip"):
        if getattr(search, name):
            out.append(F.col(name) == getattr(search, name))
    if search.protocol:
        out.append(F.upper("protocol") == protocol_name(F.lit(search.protocol.upper()), "query"))
    if search.action:
        out.append(F.lower("action") == search.action.lower())
    if search.keyword:
        hit = F.col("raw").contains(search.keyword) if raw else F.lit(False)
        out.append(hit | F.coalesce(F.col("parse_error").contains(search.keyword), F.lit(False)) if history else hit)
    if not search.include_failed:
        out.append(F.col("parse_status") == "parsed" if history else F.col("parse_status") != "failed")
    return out


def matching(events: DataFrame, search: Search, raw: bool = True, history: bool = False) -> DataFrame:
    for p in predicates(search, raw, history):
        events = events.where(p)
    return events


def search_history(events: DataFrame, search: Search) -> DataFrame:
    """A search of the history, newest first."""
    return newest(matching(events, search, history=True), search.limit)


def routed(search: Search, hot: DataFrame, history: DataFrame, as_of, hot_hours: int = 1) -> DataFrame:
    """A search of the table that holds all it asks for: the hot one if its dates begin
    within the hot window, the history otherwise."""
    first = search.date_from or (str(search.the_day()) if search.the_day() else None)
    begin = datetime.fromisoformat(first) if first else as_of
    return search_hot(hot, search) if tier_for(begin, as_of, hot_hours) == "hot" else search_history(history, search)


def first_rows(events: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first rows by ``keys`` (nulls first), then newest first: a top-k, not a sort. Its
    last step is one task that gets up to ``limit`` rows of every other one: of a limit
    beyond TOP_ROWS the rows are written, and only hours up to the one that the limit falls
    in, by their counts, go there."""
    order = [*(F.asc_nulls_first(k) for k in keys), F.desc("ingest_time"), F.desc("event_id")]
    if limit > TOP_ROWS:
        from siftline.sources.tables import kept

        events, hour = kept(events, "matches"), F.date_trunc("hour", "ingest_time")
        hours = events.groupBy(*keys, hour.alias("_hour")).agg(F.count("*").alias("_n"))
        before = Window.orderBy(*(F.asc_nulls_first(k) for k in keys), F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
        wanted = hours.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < limit).select(*(F.col(k).alias(f"_{k}") for k in keys), "_hour")
        same = hour.eqNullSafe(F.col("_hour"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        events = events.join(F.broadcast(wanted), same, "left_semi")
    return events.orderBy(*order).limit(limit)


def newest(events: DataFrame, limit: int, most: int = QUERY_LIMIT) -> DataFrame:
    """By ingest_time, then event_id, both descending."""
    return first_rows(events, [], clamp(limit, most))


def search_hot(events: DataFrame, search: Search) -> DataFrame:
    return newest(matching(events, search), search.limit)


def without_raw(events: DataFrame) -> DataFrame:
    return events.withColumn("raw", F.lit(""))


def pruned_raw(events: DataFrame) -> DataFrame:
    """Raw text only where the line was not parsed."""
    return events.withColumn("raw", F.when(F.col("parse_status") == "parsed", "").otherwise(F.col("raw")))


def slim(events: DataFrame) -> DataFrame:
    return events.select(SLIM_COLUMNS)


def adapted(events: DataFrame, path: Column | None = None) -> DataFrame:
    """Events of any known layout with all columns: ids of slim rows are hashes of their
    content and its count, so that equal rows keep apart without one global number."""
    have = set(events.columns)
    path = F.lit("") if path is None else path
    for c in EVENT_COLUMNS:
        if c not in have and c not in ("event_id", "source_addr", "raw"):
            events = events.withColumn(c, F.lit(None).cast("int" if c.endswith("port") else "timestamp" if c.endswith("time") else "string"))
    if "source_addr" not in have:
        events = events.withColumn("source_addr", F.concat(F.lit("parquet://"), path))
    if "raw" not in have:
        events = events.withColumn("raw", F.lit(""))
    if "parse_error" not in have:
        events = events.withColumn("parse_error", F.lit(""))
    if "event_id" not in have:
        content = F.sha2(F.concat_ws("\x1f", path, *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in SLIM_COLUMNS)), 256)
        events = events.withColumn("_content", content)
        nth = F.row_number().over(Window.partitionBy("_content").orderBy("ingest_time"))
        events = events.withColumn("event_id", F.concat(F.lit("parquet-"), F.substring("_content", 1, 32), F.lit("-"), nth.cast("string"))).drop("_content")
    return events.select(EVENT_COLUMNS)


def tier_rows(search: Search, hot: DataFrame | None = None, parquet: DataFrame | None = None, frozen: DataFrame | None = None, dedup: bool = False) -> DataFrame:
    """All matching rows of the tiers, in no order and without a limit, with tier_rank,
    result_source and archive_path. ``dedup`` keeps an event_id's row of the first tier alone."""
    tiers = [("hot", hot, search.scope != "archive"), ("parquet", parquet, search.scope != "hot"), ("frozen", frozen, search.scope != "hot")]
    found = None
    for rank, (name, events, wanted) in enumerate(tiers):
        if events is None or not wanted:
            continue
        path = F.col("path") if "path" in events.columns else F.lit(None).cast("string")
        rows = matching(events.withColumn("archive_path", path), search).withColumn("tier_rank", F.lit(rank)).withColumn("result_source", F.lit(name))
        rows = rows.select(*EVENT_COLUMNS, "tier_rank", "result_source", "archive_path")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no tier to search")
    if dedup:
        # a window, where a join would make the rows twice
        first = F.min("tier_rank").over(Window.partitionBy("event_id"))
        found = found.where("event_id is not null").withColumn("_first", first).where("tier_rank = _first").drop("_first")
    return found


def tiered(search: Search, hot: DataFrame | None = None, parquet: DataFrame | None = None, frozen: DataFrame | None = None, dedup: bool = False) -> DataFrame:
    """Hot rows first, then Parquet archives (by ``path``), then frozen ones, each newest
    first, up to the limit. Adds result_source and archive_path."""
    found = tier_rows(search, hot, parquet, frozen, dedup)
    return first_rows(found, ["tier_rank", "archive_path"], clamp(search.limit, QUERY_LIMIT)).drop("tier_rank")


def tier_for(oldest_needed, as_of, hot_hours: int = 1) -> str:
    """Which table answers a query that starts at ``oldest_needed``."""
    return "history" if oldest_needed < as_of - timedelta(hours=hot_hours) else "hot"


def archive_path(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, "^(?:parquet|frozen)://(.*)$", 1), F.lit(""))


def transport(source: Column) -> Column:
    return F.when(source.startswith("udp://"), "UDP").when(source.startswith("tcp://"), "TCP").when(source.startswith("frozen://"), "Frozen").otherwise("Unknown")


def device_name(source: Column, raw: Column) -> Column:
    """The source without its scheme; of legacy rows the host of the syslog header."""
    host = F.nullif(F.regexp_extract(raw, r"^(?:<[0-9]+>)?[A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9:]{8}\s+(\S+)", 1), F.lit(""))
    return F.when(source.startswith("unknown://"), F.coalesce(host, source)).otherwise(F.regexp_replace(source, "^[a-z]+://", ""))


def with_history_nulls(events: DataFrame) -> DataFrame:
    """The history layout's blanks back to nulls; event_time of its own only if it differs."""
    for c in ("device_id", "vendor", "product", "src_ip", "dst_ip", "protocol", "action", "severity", "parse_error"):
        events = events.withColumn(c, F.nullif(F.col(c), F.lit("")))
    for c in ("src_port", "dst_port"):
        events = events.withColumn(c, F.nullif(F.col(c), F.lit(0)))
    return events


def to_history(events: DataFrame) -> DataFrame:
    """The history layout: no nulls, event_time falls back to ingest_time."""
    for c in ("device_id", "vendor", "product", "src_ip", "dst_ip", "protocol", "action", "severity", "parse_error"):
        events = events.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("src_port", "dst_port"):
        events = events.withColumn(c, F.coalesce(c, F.lit(0)))
    return events.withColumn("event_time", F.coalesce("event_time", "ingest_time"))


def upgraded(events: DataFrame) -> DataFrame:
    """Rows of the first layouts: a legacy source and no device."""
    if "source_addr" not in events.columns:
        events = events.withColumn("source_addr", F.lit("unknown://legacy"))
    events = events.withColumn("source_addr", F.coalesce("source_addr", F.lit("unknown://legacy")))
    return events if "device_id" in events.columns else events.withColumn("device_id", F.lit(None).cast("string"))


def within(events: DataFrame, start, end) -> DataFrame:
    """Events of a history query: ingest_time from ``start`` to ``end``, both included. Of a
    table stored by ingest_day only those days are read."""
    if "ingest_day" in events.columns:
        events = events.where(F.col("ingest_day").between(F.lit(start.date()), F.lit(end.date())))
    return events.where(F.col("ingest_time").between(F.lit(start), F.lit(end)))


def recent_stream(events: DataFrame, limit: int = 40) -> DataFrame:
    """The newest rows as a stream view shows them: time, status, device, raw."""
    rows = newest(events, limit)
    return rows.select("event_id", F.coalesce("event_time", "ingest_time").alias("time"), "parse_status", device_name(F.col("source_addr"), F.col("raw")).alias("device"), "raw")


def oldest(events: DataFrame, after=None, limit: int = QUERY_LIMIT) -> DataFrame:
    """The next rows of a sync, oldest first, at most ``limit``. ``after`` is a time, whose
    rows are all done, or the (time, event_id) of the last row done: rows of equal times on
    both sides of a page's end are each on one page."""
    rows = events
    if isinstance(after, tuple):
        at, last = F.lit(after[0]), F.lit(after[1])
        rows = events.where((F.col("ingest_time") > at) | ((F.col("ingest_time") == at) & (F.col("event_id") > last)))
    elif after is not None:
        rows = events.where(F.col("ingest_time") > F.lit(after))
    return rows.orderBy("ingest_time", "event_id").limit(clamp(limit, QUERY_LIMIT))
