"""Minute rollups kept by deltas: what a batch adds or takes away, by bucket.

``parts`` holds a signed partial aggregate for each batch, of the buckets that the batch
touches and no others; a batch that comes again writes the same folder. ``base`` holds
days that were compacted, each in the version that wrote it. A version is one small file
that lists the days' versions and the parts they cover; it is claimed before it is written
and read only when it is whole, so readers see a compaction entirely or not at all.
"""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.metrics import KEYS, minute_rollup
from siftline.sources.sinks import exists

SUMS = ["total_count", "raw_bytes"]
ROW = "bucket_minute timestamp, source_addr string, protocol string, action string, parse_status string, total_count long, raw_bytes long"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str = "") -> bool:
    """Write a small file unless it is there; False if it was. Of two writers one wins."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        try:
            handle = os.open(url.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as out:
            out.write(text)
        return True
    system, where = _fs(spark, path)
    try:
        out = system.create(where, False)
    except Exception as e:  # noqa: BLE001
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    system, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


class Rollups:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -------- writing

    def add(self, name: str, fresh: DataFrame, gone: DataFrame | None = None) -> None:
        """The batch ``name``: events that are new and, after a replacement, events that
        are gone. Only their buckets are written."""
        path = f"{self.root}/parts/{name}"
        if "_SUCCESS" in names_in(self.spark, path):
            return
        rows = minute_rollup(fresh)
        if gone is not None:
            less = minute_rollup(gone).withColumns({c: -F.col(c) for c in SUMS})
            rows = rows.unionByName(less).groupBy(KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("total_count <> 0 or raw_bytes <> 0")
        rows.withColumn("bucket_day", F.to_date("bucket_minute")).write.mode("overwrite").partitionBy("bucket_day").parquet(path)

    # -------- versions

    def manifest(self) -> dict:
        """The newest whole version: its number, days by the version that holds them, parts covered."""
        for name in reversed(names_in(self.spark, f"{self.root}/versions")):
            if name.endswith(".json") and not name.startswith("."):
                text = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/versions/{name}").collect())
                try:
                    return json.loads(text)
                except ValueError:  # its writer stopped half-way
                    continue
        return {"version": 0, "days": {}, "parts": []}

    def compact(self) -> int | None:
        """Fold the parts into the days that they touch; other days stay where they are.
        The new version, or None if there is nothing to fold or another writer was first."""
        now = self.manifest()
        parts = [p for p in names_in(self.spark, f"{self.root}/parts") if p not in now["parts"] and "_SUCCESS" in names_in(self.spark, f"{self.root}/parts/{p}")]
        if not parts:
            return None
        version = now["version"] + 1
        if not put_if_absent(self.spark, f"{self.root}/claims/{version:012d}"):
            return None
        fresh = self._parts(parts)
        days = sorted(str(r[0]) for r in fresh.select("bucket_day").distinct().collect())  # at most one for each day
        rows = self._base({d: v for d, v in now["days"].items() if d in days}).unionByName(fresh)
        self._merged(rows).withColumn("bucket_day", F.to_date("bucket_minute")).write.partitionBy("bucket_day").parquet(f"{self.root}/base/version={version}")
        text = json.dumps({"version": version, "days": now["days"] | dict.fromkeys(days, version), "parts": now["parts"] + parts})
        put_if_absent(self.spark, f"{self.root}/versions/{version:012d}.json", text)
        return version

    def rebuild(self, events: DataFrame) -> int:
        """A version made of all events, after a table was replaced."""
        now = self.manifest()
        parts, version = names_in(self.spark, f"{self.root}/parts"), now["version"] + 1
        while not put_if_absent(self.spark, f"{self.root}/claims/{version:012d}"):
            version += 1
        path = f"{self.root}/base/version={version}"
        minute_rollup(events).withColumn("bucket_day", F.to_date("bucket_minute")).write.partitionBy("bucket_day").parquet(path)
        days = [n.partition("=")[2] for n in names_in(self.spark, path) if n.startswith("bucket_day=")]
        put_if_absent(self.spark, f"{self.root}/versions/{version:012d}.json", json.dumps({"version": version, "days": dict.fromkeys(days, version), "parts": parts}))
        return version

    def vacuum(self) -> int:
        """Delete parts that the newest version covers, and days that it doesn't use."""
        now, n = self.manifest(), 0
        for p in now["parts"]:
            system, where = _fs(self.spark, f"{self.root}/parts/{p}")
            # the marker stays: a batch that comes again must find that it was counted
            for status in system.listStatus(where) if system.exists(where) else []:
                if status.getPath().getName() != "_SUCCESS":
                    n += bool(system.delete(status.getPath(), True))
        for folder in names_in(self.spark, f"{self.root}/base"):
            version = int(folder.partition("=")[2])
            for day in names_in(self.spark, f"{self.root}/base/{folder}"):
                if day.startswith("bucket_day=") and version <= now["version"] and now["days"].get(day.partition("=")[2]) != version:
                    system, where = _fs(self.spark, f"{self.root}/base/{folder}/{day}")
                    n += bool(system.delete(where, True))
        return n

    # -------- reading

    def _parts(self, parts: list[str]) -> DataFrame:
        have = [f"{self.root}/parts/{p}" for p in parts if exists_rows(self.spark, f"{self.root}/parts/{p}")]
        schema = f"{ROW}, bucket_day date"
        if not have:
            return self.spark.createDataFrame([], schema)
        out = None
        for path in have:
            part = self.spark.read.schema(schema).parquet(path)
            out = part if out is None else out.unionByName(part)
        return out

    def _base(self, days: dict[str, int]) -> DataFrame:
        schema = f"{ROW}, bucket_day date"
        if not days:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version int").parquet(f"{self.root}/base")
        keep = F.lit(False)
        for version in sorted(set(days.values())):
            keep |= (F.col("version") == version) & F.col("bucket_day").isin([d for d, v in days.items() if v == version])
        return rows.where(keep).drop("version")

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("total_count <> 0")

    def rows(self) -> DataFrame:
        """The rollup as it is: compacted days and the parts since, added up."""
        now = self.manifest()
        parts = [p for p in names_in(self.spark, f"{self.root}/parts") if p not in now["parts"] and "_SUCCESS" in names_in(self.spark, f"{self.root}/parts/{p}")]
        return self._merged(self._base(now["days"]).unionByName(self._parts(parts)))


def exists_rows(spark: SparkSession, path: str) -> bool:
    return any(n.startswith("bucket_day=") for n in names_in(spark, path))


def insert_with_rollup(batch: DataFrame, hot: str, rollups: Rollups, name: str) -> int:
    """Insert or ignore by event_id and add what is new to the rollup, once: the delta is
    written before the rows, so a batch that was cut off is counted anew and one that comes
    again finds its delta. The number of new rows."""
    from siftline.operators.joins import new_events
    from siftline.sources.sinks import append_events

    spark, batch = batch.sparkSession, batch.persist()  # its days, its delta and its rows read it, but it is made once
    try:
        fresh = batch.dropDuplicates(["event_id"])
        if exists(spark, hot):
            days = [r[0] for r in batch.select(F.to_date("ingest_time").alias("d")).distinct().collect()]
            fresh = new_events(batch, spark.read.parquet(hot).where(F.col("ingest_day").isin(days)))
        rollups.add(name, fresh)
        return append_events(batch, hot)
    finally:
        batch.unpersist()


def import_csv(spark: SparkSession, path: str, hot: str, rollups: Rollups, name: str) -> int:
    """Events of CSV files into a table, insert or ignore, and into its rollup; new rows."""
    from siftline.sources.files import csv_events

    return insert_with_rollup(csv_events(spark, path), hot, rollups, name)


def replace_with_rollup(events: DataFrame, hot: str, rollups: Rollups, expected: int) -> int:
    """Replace a table and then its rollup; the rollup's new version. If it stops between
    the two, running the rebuild alone puts it right."""
    from siftline.sources.sinks import replace_events

    replace_events(events, hot, expected)
    return rollups.rebuild(events.sparkSession.read.parquet(hot))


def rollup_batch(hot: str, rollup: str, every: int = 100):
    """A foreachBatch function: batches to the hot table and deltas to the rollup, which
    is compacted every so many batches."""

    def run(batch: DataFrame, number: int) -> None:
        from siftline.streaming.stream import stream_id

        rollups = Rollups(batch.sparkSession, rollup)
        insert_with_rollup(batch, hot, rollups, f"{stream_id(batch.sparkSession)}-{number:012d}")
        if number and number % every == 0:
            rollups.compact()

    return run
