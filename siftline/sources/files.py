"""Sources: text and gzip logs, Zstd and tar archives, Parquet, CSV and spool files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.metrics import days_in
from siftline.operators.parse import parse_events
from siftline.operators.search import adapted
from siftline.schema import EVENT, SPOOL
from siftline.sources.archives import frozen_scan


def text_logs(spark: SparkSession, path: str, ingest_time) -> DataFrame:
    """Lines of plain and gzip files below ``path``: ingest_time, source_addr, raw. Empty
    files and lines, files named ``read me.txt`` and gzip files of at most 20 bytes are
    left out; bytes that are no UTF-8 are replaced."""
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    # a gzip file is read by one task: its lines are dealt out before they are parsed
    name, size = F.lower("_metadata.file_name"), F.col("_metadata.file_size")
    fine = (name != "read me.txt") & (F.replace(name, F.lit("%20"), F.lit(" ")) != "read me.txt") & ~(name.endswith(".gz") & (size <= 20))
    packed = name.endswith(".gz")
    rows = rows.where(fine)
    if not rows.where(packed).limit(1).isEmpty():
        rows = rows.select("value", "_metadata").repartition(max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    return rows.select(
        F.lit(ingest_time).cast("timestamp").alias("ingest_time"),
        F.concat(F.lit("file://"), F.regexp_replace("_metadata.file_path", "^file:/*", "/")).alias("source_addr"),
        F.regexp_replace("value", r"[\r\n]+$", "").alias("raw"),
    ).where(F.length("raw") > 0)


def frozen_lines(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """(path, member, line_no, raw) of ``*.raw.zst`` and ``raw-import-*.tar.zst`` files. A
    day (yyyy-mm-dd) leaves out files and members whose names hold another day, before they
    are opened. Raw archives are read frame by frame by many tasks: line_no orders the lines
    of a file, with gaps between frames."""
    return frozen_scan(spark, path, day)


def frozen_time() -> Column:
    """The time of a frozen line (path, member): the day that the archive's or member's
    name tells, so that it is the same in every search."""
    name = F.concat_ws("/", F.regexp_extract("path", "([^/]*)$", 1), "member")
    return F.coalesce(F.get(days_in(name), F.lit(0)).cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))


def frozen_raw(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Frozen lines as raw logs. Their time is the archive's day, so that ids and date
    filters are the same in every search."""
    rows, when = frozen_lines(spark, path, day), frozen_time()
    source = F.when(F.col("path").endswith(".tar.zst"), F.col("member")).otherwise(F.col("path"))
    return rows.select(when.alias("ingest_time"), F.concat(F.lit("frozen://"), source).alias("source_addr"), "raw", "path")


def frozen_events(spark: SparkSession, path: str, keyword: str | None = None, day: str | None = None, **parse) -> DataFrame:
    """Parsed frozen lines; a keyword drops lines before they are parsed."""
    rows = frozen_raw(spark, path, day)
    return parse_events(rows if keyword is None else rows.where(F.col("raw").contains(keyword)), **parse)


def parquet_events(spark: SparkSession, path: str) -> DataFrame:
    """Archived events of any known layout, with the file in ``path``."""
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return adapted_with_path(rows)


def adapted_with_path(rows: DataFrame) -> DataFrame:
    whole = "event_id" in rows.columns
    if not whole:
        return adapted(rows, F.col("path")).withColumn("path", F.regexp_replace("source_addr", "^parquet://", ""))
    slim = rows.where("event_id is null")
    full = rows.where("event_id is not null")
    done = adapted(full).withColumn("path", F.lit(None).cast("string")) if "path" not in full.columns else full.select(*adapted(full).columns, "path")
    made = adapted(slim.drop("event_id"), F.col("path")).withColumn("path", F.lit(None).cast("string"))
    return done.unionByName(made)


def csv_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def spool(spark: SparkSession, path: str, committed: int = -1) -> DataFrame:
    """Raw logs of sealed and open spool segments after the committed offset."""
    rows = spark.read.schema(SPOOL).option("pathGlobFilter", "*.{sealed,open}").json(path)
    return rows.where(F.col("offset") > committed)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, mtime, category) of the archives below ``path``; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    category = F.when(F.col("path").endswith(".parquet"), "parquet").when(F.col("path").rlike(r"\.raw\.zst$|/raw-import-[^/]*\.tar\.zst$"), "frozen")
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), category.alias("category")).where("category is not null").orderBy("path")


def index_rows(lines: DataFrame) -> DataFrame:
    """An archive's index row: lines, the day that its name or first member tells, its
    first member and the day's bounds."""
    rows = lines.groupBy("path").agg(F.count("*").alias("line_count"), F.min_by("member", "line_no").alias("source_addr"))
    day = F.get(days_in(F.concat_ws("/", F.regexp_extract("path", "([^/]*)$", 1), "source_addr")), F.lit(0))
    start = day.cast("timestamp")
    return rows.select(
        F.col("path").alias("archive_path"), F.coalesce(day.cast("string"), F.lit("unknown")).alias("day"), "source_addr", "line_count",
        start.alias("first_seen"), (start + F.expr("interval '23:59:59' hour to second")).alias("last_seen"),
    )


def reparsed(events: DataFrame, **parse) -> DataFrame:
    """Stored events parsed again under their ids; refused if a raw line is missing."""
    if not events.where("raw is null or raw = ''").isEmpty():
        raise ValueError("some stored events have no raw line")
    lines = events.select("ingest_time", "source_addr", "raw", F.col("event_id").alias("stored_id"))
    out = parse_events(lines, **parse)
    return out.withColumn("event_id", F.col("stored_id")).drop("stored_id", "scope_key")
