"""Sinks: event tables, Parquet, CSV and Zstd archives, versioned state."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftline.operators.joins import new_events
from siftline.operators.search import EXPORT_LIMIT, clamp, newest, slim, tier_rows
from siftline.schema import EVENT_COLUMNS
from siftline.sources.archives import write_zst

FROZEN_ROWS = 1_000_000


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def append_events(batch: DataFrame, target: str) -> int:
    """Insert or ignore by event_id into a table partitioned by ingest_day; the number of
    new rows. Only the days that the batch touches are read."""
    spark = batch.sparkSession
    batch = batch.select(EVENT_COLUMNS).withColumn("ingest_day", F.to_date("ingest_time"))
    fresh = batch.dropDuplicates(["event_id"])
    if exists(spark, target):
        days = [r[0] for r in batch.select("ingest_day").distinct().collect()]
        stored = spark.read.parquet(target).where(F.col("ingest_day").isin(days))
        fresh = new_events(batch, stored)
    # counted from a cached copy: an observed metric never arrives where Spark finds the
    # rest of the plan to be empty
    fresh = fresh.persist()
    try:
        if n := fresh.count():
            fresh.write.mode("append").partitionBy("ingest_day").option("compression", "zstd").parquet(target)
        return n
    finally:
        fresh.unpersist()


def replace_events(events: DataFrame, target: str, expected: int) -> None:
    """Replace a table after checking that no row is lost. If the new one can't be put in
    place, the old one is put back; it is deleted last."""
    spark = events.sparkSession
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    events.withColumn("ingest_day", F.to_date("ingest_time")).write.partitionBy("ingest_day").option("compression", "zstd").parquet(staged)
    n = spark.read.parquet(staged).count()
    if n != expected:
        raise ValueError(f"{n} rows were written, {expected} expected; the table stays as it is")
    jvm = spark._jvm.org.apache.hadoop.fs
    old, new = jvm.Path(target), jvm.Path(staged)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.Path(f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{target} can't be moved; it stays as it is")
    if not fs.rename(new, old):
        if had and not fs.rename(aside, old):
            raise OSError(f"the old table is at {aside.toString()}, the new one at {staged}: neither can be moved to {target}")
        raise OSError(f"{staged} can't be moved to {target}; the old table stays")
    if had:
        fs.delete(aside, True)


def write_events(events: DataFrame, target: str, mode: str = "append") -> None:
    events.write.mode(mode).option("compression", "zstd").parquet(target)


def write_slim(events: DataFrame, target: str, limit: int | None = None) -> None:
    rows = slim(events.withColumn("source_addr", F.coalesce("source_addr", F.lit(""))))
    write_events(rows if limit is None else rows.limit(limit), target)


def _frozen(batches):
    import zstandard

    held, n = [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=3).compress("".join(held).encode())], pa.binary()), pa.array([n], pa.int64())], ["content", "lines"])

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            held.append(raw + "\n")
            n += 1
            if n >= FROZEN_ROWS:
                yield row()
                held, n = [], 0
    if n:
        yield row()


def _frozen_files(target: str):
    """Rows (day, raw) in order: each day's lines of a task as files of bounded size. A
    file gets its final name when it is complete; a task that runs again writes the same."""

    def run(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
        system.create_dir(root, recursive=True)
        day, held, number = None, [], 0

        def write():
            name = f"{root}/raw-{day}-{task.partitionId():05d}-{number:05d}.raw.zst"
            packed = zstandard.ZstdCompressor(level=3).compress("".join(held).encode())
            with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(packed)
            system.move(f"{name}.{task.taskAttemptId()}", name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(packed)], pa.int64())], ["path", "lines", "bytes"])

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (d != day or len(held) >= FROZEN_ROWS):
                    yield write()
                    number, held = number + 1, []
                day = d
                held.append(raw + "\n")
        if held:
            yield write()

    return run


def write_frozen(events: DataFrame, target: str) -> int:
    """Raw lines in order of time as ``raw-<day>-<task>-<n>.raw.zst`` files of at most
    FROZEN_ROWS lines, written by the tasks to a file system that all can reach; the
    number of files."""
    order = ["day", "ingest_time", "event_id"]
    rows = events.select(F.date_format("ingest_time", "yyyyMMdd").alias("day"), "ingest_time", "event_id", "raw")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("day", "raw")
    return rows.mapInArrow(_frozen_files(target), "path string, lines long, bytes long").agg(F.count("*")).first()[0]


def export(events: DataFrame, target: str, kind: str = "csv.zst", limit: int = 100_000) -> int:
    """The newest rows as csv, csv.zst or parquet under ``target``; the number of rows. A
    csv.zst file is compressed by many tasks and gets its name when it is whole."""
    rows = newest(events, clamp(limit, EXPORT_LIMIT), EXPORT_LIMIT).select(EVENT_COLUMNS)
    rows = rows.persist()
    n = rows.count()
    if kind == "parquet":
        rows.write.mode("overwrite").option("compression", "zstd").parquet(target)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(target)
    elif kind == "csv.zst":
        line = F.to_csv(F.struct(*EVENT_COLUMNS), {"escape": '"'})
        order = [F.desc("ingest_time"), F.desc("event_id")]
        write_zst(rows, order, line, f"{target}/export.csv.zst", ",".join(EVENT_COLUMNS) + "\n")
    else:
        raise ValueError("kind is csv, csv.zst or parquet")
    rows.unpersist()
    return n


def search_export(search, target: str, hot: DataFrame | None = None, parquet: DataFrame | None = None, frozen: DataFrame | None = None, kind: str = "csv.zst") -> int:
    """What a search over tiers finds, hot rows first, as an export; the number of rows."""
    rows = tier_rows(search, hot, parquet, frozen)
    return export(rows, target, kind, search.limit)


def publish_state(tables: dict[str, DataFrame], root: str) -> int:
    """Write a new version of the state tables; its manifest row, with their counts, is
    written last, so readers never see half a version. A version's number is claimed before
    anything is written: of two writers at once each has its own."""
    from siftline.sources.rollups import put_if_absent

    spark = next(iter(tables.values())).sparkSession
    version = (latest_version(spark, root) or 0) + 1
    while not put_if_absent(spark, f"{root}/claims/{version:012d}"):
        version += 1
    counts = []
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{root}/version={version}/{name}")
        counts.append((version, name, spark.read.parquet(f"{root}/version={version}/{name}").count()))
    # a folder for each version: writers that append to one folder undo each other's commits
    spark.createDataFrame(counts, "version long, name string, n long").coalesce(1).write.parquet(f"{root}/manifest/part={version}")
    return version


def state_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, name, n) of what was published, the newest version first."""
    return manifest(spark, root).orderBy(F.desc("version"), "name")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/manifest")


def latest_version(spark: SparkSession, root: str) -> int | None:
    return manifest(spark, root).agg(F.max("version")).first()[0] if exists(spark, f"{root}/manifest") else None


def state(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={latest_version(spark, root)}/{name}")
