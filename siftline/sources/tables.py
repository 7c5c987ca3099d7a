"""Stored event tables: written once by ingest_day, then searched without parsing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.schema import EVENT_COLUMNS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; in a folder of our own
    only on a single machine that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: what uses it several
    times doesn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def store(events: DataFrame, path: str) -> None:
    """Write events by ingest_day, a day's rows in order of time: filters of days skip
    partitions, filters of times row groups. Days of any size are dealt to several files
    by the hour."""
    rows = events.select(EVENT_COLUMNS).withColumn("ingest_day", F.to_date("ingest_time"))
    dealt = rows.repartition("ingest_day", F.hour("ingest_time")).sortWithinPartitions("ingest_day", "ingest_time")
    dealt.write.partitionBy("ingest_day").option("compression", "zstd").parquet(path)


def write_bounds(spark: SparkSession, path: str) -> None:
    """Write, beside a stored table, each day's rows and its first and last time of events:
    a search by event times then reads the days that can hold them and no others."""
    at = F.coalesce("event_time", "ingest_time")
    facts = spark.read.parquet(path).groupBy("ingest_day").agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    facts.write.mode("overwrite").parquet(f"{path}-bounds")


def bounded(spark: SparkSession, path: str, date_from, date_to) -> DataFrame:
    """A stored table's days that may hold events of these dates (None: no bound). The join
    with the days' bounds, one row a day, is what Spark prunes partitions by."""
    days = spark.read.parquet(f"{path}-bounds").where("n > 0")
    if date_from is not None:
        days = days.where(F.to_date("last_seen") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        days = days.where(F.to_date("first_seen") <= F.lit(date_to).cast("date"))
    return spark.read.parquet(path).join(F.broadcast(days.select("ingest_day")), "ingest_day", "left_semi")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
