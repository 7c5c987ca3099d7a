"""Searches of archives: in the order of their paths until a limit, or by an index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.joins import with_regions
from siftline.operators.parse import parse_events
from siftline.operators.search import COLD_LIMIT, QUERY_LIMIT, Search, clamp, matching, tiered
from siftline.schema import EVENT_COLUMNS
from siftline.sources.archives import frame_index, indexed_lines, listing, on_day
from siftline.sources.files import adapted_with_path, frozen_time
from siftline.sources.tables import kept, scratch

#: bits of an archive's filter, and its hashes; sources that an index row lists
FILTER_BITS, HASHES, SOURCES = 14, 4, 64
#: index rows that are broadcast, which lets Spark prune the archives' partitions
INDEX_ROWS = 1_000_000


@dataclass
class Found:
    """A cold search: its events and what it took. ``files`` could hold matches, ``opened``
    were read, ``scanned`` frozen lines were looked at up to the last match."""

    events: DataFrame
    files: int
    opened: int
    scanned: int
    matched: int
    limited: bool

    def report(self) -> DataFrame:
        row = (self.files, self.scanned, self.matched, self.limited)
        return self.events.sparkSession.createDataFrame([row], "files long, scanned_lines long, matched long, limited boolean")


def growing(items: list, first: int):
    """Items in order in batches, each twice as large as the one before."""
    at = 0
    while at < len(items):
        yield items[at : at + first]
        at, first = at + first, first * 2


def parquet_files(spark: SparkSession, path: str, day: str | None = None) -> list[str]:
    """Parquet archives below a path in order, without those whose paths hold another day;
    names alone are listed, as Spark does for any scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return [p for (p,) in sorted(files.select("path").toLocalIterator()) if on_day(p, day)]


def cold_search(spark: SparkSession, search: Search, parquet: str | None = None, frozen: str | None = None, index: DataFrame | None = None, batch: int | None = None, **parse) -> Found:
    """Parquet archives in order of their paths, each newest first, then frozen ones for
    the rest, in order of path and line, until the limit. Archives are read in batches
    that double: those behind the limit stay unread. With an index (archive_path, day,
    source_addr) of frozen archives and a day, only those it lists are read; where it lists
    none, all whose names fit."""
    limit, day = clamp(search.limit, COLD_LIMIT), str(search.the_day()) if search.the_day() else None
    batch = batch or spark.sparkContext.defaultParallelism
    out, matched, opened, scanned, limited = scratch(spark, "cold"), 0, 0, 0, False
    columns = [*EVENT_COLUMNS, "result_source", "archive_path", "place"]

    def keep(rows: DataFrame, tier: str, order: list) -> int:
        rows = rows.orderBy(*order).limit(limit - matched).withColumn("result_source", F.lit(tier))
        rows.select(columns).write.mode("append").parquet(out)
        return spark.read.parquet(out).count()

    warm = parquet_files(spark, parquet, day) if parquet else []
    for paths in growing(warm, batch):
        rows = spark.read.option("mergeSchema", True).parquet(*paths).withColumn("path", F.col("_metadata.file_path"))
        rows = matching(adapted_with_path(rows).withColumn("archive_path", F.coalesce("path", F.lit(""))), search)
        matched = keep(rows.withColumn("place", F.lit(0).cast("long")), "parquet", ["archive_path", F.desc("ingest_time"), F.desc("event_id")])
        opened += len(paths)
        if limited := matched >= limit:
            break
    cold = frozen_candidates(frozen, day, search.device, index) if frozen else []
    for paths in [] if limited else growing(cold, batch):
        lines = indexed_lines(frame_index(spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))), day)
        rows = lines if search.keyword is None else lines.where(F.col("raw").contains(search.keyword))
        # names end in the folder that is searched: a device is looked for in what is parsed
        events = parse_events(rows.select(frozen_time().alias("ingest_time"), F.concat(F.lit("frozen://"), F.when(F.col("path").endswith(".tar.zst"), F.col("member")).otherwise(F.col("path"))).alias("source_addr"), "raw", F.col("path").alias("archive_path"), F.col("line_no").alias("place")), **parse)
        before, matched = matched, keep(matching(events, search), "frozen", ["archive_path", "place"])
        opened += len(paths)
        if limited := matched >= limit:
            last = spark.read.parquet(out).where("result_source = 'frozen'").agg(F.max(F.struct("archive_path", "place")).alias("m")).first()["m"]
            lines = lines.where((F.col("path") < last[0]) | ((F.col("path") == last[0]) & (F.col("line_no") <= last[1])))
        scanned += lines.count()
        if limited:
            break
    if not opened:
        spark.createDataFrame([], parse_events(spark.createDataFrame([], "ingest_time timestamp, source_addr string, raw string")).select(EVENT_COLUMNS).schema).select(
            *EVENT_COLUMNS, F.lit("").alias("result_source"), F.lit("").alias("archive_path"), F.lit(0).cast("long").alias("place")
        ).write.mode("append").parquet(out)
    return Found(spark.read.parquet(out).select(columns), len(warm) + len(cold), opened, scanned, matched, limited)


def frozen_candidates(path: str, day: str | None, device: str | None, index: DataFrame | None) -> list[str]:
    if index is not None and day is not None:
        rows = index.where(F.col("day").cast("string") == day)
        if device:
            rows = rows.where(F.col("source_addr").contains(device) | F.col("archive_path").contains(device))
        listed = sorted(r[0] for r in rows.select("archive_path").distinct().toLocalIterator())
        if listed:
            return listed
    return listing(path, day)


def unified(search: Search, rules: DataFrame, ranges: DataFrame, hot: DataFrame | None = None, parquet: DataFrame | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """A search over hot rows and archives with the regions of the rows it finds: the
    limit comes first, so that only those are looked up, and the search runs once."""
    return with_regions(kept(tiered(search, hot, parquet, frozen), "found"), rules, ranges)


# ---------------------------------------------------------------- index


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(1 << FILTER_BITS)) for i in range(HASHES)]


def archive_index(events: DataFrame, key: str = "archive") -> DataFrame:
    """One row for each archive (``key``): rows, first_seen and last_seen of event_time or
    ingest_time, up to SOURCES sources (null: more) and a Bloom filter of addresses as 64-bit
    words by number. Words are or-ed before anything moves."""
    at = F.coalesce("event_time", "ingest_time")
    facts = events.groupBy(key).agg(
        F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min("ingest_time").alias("first_ingest"), F.max("ingest_time").alias("last_ingest")
    )
    sources = events.select(key, "source_addr").distinct().groupBy(key).agg(F.count("*").alias("k"), F.slice(F.collect_set("source_addr"), 1, SOURCES).alias("sources"))
    bits = events.select(key, F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct().select(key, F.explode(F.array(*_bits(F.col("ip")))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(bit & 63 as int)"))
    words = bits.groupBy(key, F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    filters = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("filter"))
    rows = facts.join(sources, key, "left").join(filters, key, "left")
    return rows.withColumn("sources", F.when(F.col("k") <= SOURCES, F.col("sources"))).drop("k")


def may_hold(index: DataFrame, search: Search) -> DataFrame:
    """The index rows of archives that may hold matches: by days, sources and addresses."""
    if search.date_from:
        index = index.where(F.to_date("last_seen") >= F.lit(search.date_from).cast("date"))
    if search.date_to:
        index = index.where(F.to_date("first_seen") <= F.lit(search.date_to).cast("date"))
    if search.device:
        index = index.where(F.col("sources").isNull() | F.exists("sources", lambda s: s.contains(search.device)))
    for ip in filter(None, (search.src_ip, search.dst_ip)):
        hits = [
            F.coalesce(F.call_function("shiftright", F.element_at("filter", F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")), F.lit(0).cast("long")).bitwiseAND(F.lit(1)) == 1
            for b in _bits(F.lit(ip))
        ]
        index = index.where(reduce(lambda a, b: a & b, hits))
    # Spark prunes by a join only behind a comparison; every archive has rows
    return index.where("n > 0")


def indexed_search(events: DataFrame, index: DataFrame, search: Search, key: str = "archive") -> DataFrame:
    """Matches, newest first, of a table of archives partitioned by ``key``. The archives
    that the index leaves restrict the scan by a join, so Spark prunes the partitions when
    it runs and no path goes through the driver."""
    fit = may_hold(index, search).select(key)
    if index.count() <= INDEX_ROWS:
        fit = F.broadcast(fit)
    rows = matching(events.join(fit, key, "left_semi"), search)
    return rows.orderBy(F.desc("ingest_time"), F.desc("event_id")).limit(clamp(search.limit, QUERY_LIMIT))
