"""Structured Streaming: lines to events, rollups that stay right, learning, syncs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.joins import new_events
from siftline.operators.metrics import filled, history_view, merged, minute_rollup
from siftline.operators.parse import apply_learned, parse_events, source_scope
from siftline.operators.search import QUERY_LIMIT
from siftline.schema import COUNTERS, RAW, RULE
from siftline.sources.sinks import append_events, exists

#: fixed values: the history's views, by unit and keys
VIEWS = {
    "minute": ("minute", ["source_addr", "protocol", "action", "parse_status"]),
    "source": ("hour", ["source_addr"]),
    "protocol": ("hour", ["protocol", "action"]),
}


def line_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Raw logs from JSON files as they arrive. ``files`` caps a micro-batch; nothing is
    dropped when lines come faster."""
    reader = spark.readStream.schema(RAW)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path)


def event_stream(lines: DataFrame, delay: str = "10 minutes", **parse) -> DataFrame:
    """Events of a line stream; a line that is replayed within the delay has the same id
    and comes once."""
    return parse_events(lines, **parse).drop("scope_key").withWatermark("ingest_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def minute_stream(events: DataFrame) -> DataFrame:
    """Rollup rows of a stream, by minute; use update mode."""
    window = F.window("ingest_time", "1 minute")
    keys = [
        filled("source_addr", "unknown").alias("source_addr"), filled("protocol", "UNKNOWN", F.upper).alias("protocol"),
        filled("action", "unknown", F.lower).alias("action"), F.col("parse_status"),
    ]
    rows = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("total_count"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).cast("long").alias("raw_bytes"))
    return rows.select(F.col("w.start").alias("bucket_minute"), "source_addr", "protocol", "action", "parse_status", "total_count", "raw_bytes")


def store_batch(hot: str, history: str | None = None, rollup: str | None = None):
    """A foreachBatch function: each batch goes to the hot and history tables once, and
    the rollup's touched days are written again from the stored events, so late lines and
    repeated batches leave it right."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            append_events(batch, hot)
            if history:
                append_events(batch, history)
            if rollup:
                days = [r[0] for r in batch.select(F.to_date("ingest_time").alias("d")).distinct().collect()]
                stored = spark.read.parquet(hot).where(F.col("ingest_day").isin(days))
                again = minute_rollup(stored).withColumn("ingest_day", F.to_date("bucket_minute"))
                if days:
                    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_day").parquet(rollup)
        finally:
            batch.unpersist()

    return run


def stream_id(spark: SparkSession) -> str:
    """The id of the stream that calls a foreachBatch function: its checkpoint's, so that a
    new checkpoint, whose batches are numbered from 0 again, has another; "0" outside."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"


def history_batch(history: str, views: str, run: str | None = None):
    """A foreachBatch function: the rows of a batch that the history lacks are added up
    under ``views``, a partial aggregate for each view and batch, and then stored. A batch
    that comes again finds its aggregates written and only stores what is missing; one that
    was cut off is aggregated anew, as its rows are stored last. ``run`` names the stream's
    checkpoint, whose batches are numbered from 0; by default the stream's own id."""

    def run_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs
        batch = batch.withColumn("ingest_day", F.to_date("ingest_time")).persist()
        try:
            fresh = batch.dropDuplicates(["event_id"])
            if exists(spark, history):
                days = [r[0] for r in batch.select("ingest_day").distinct().collect()]
                fresh = new_events(batch, spark.read.parquet(history).where(F.col("ingest_day").isin(days)))
            for name, (unit, keys) in VIEWS.items():
                path = f"{views}/{name}/run={run or stream_id(spark)}/batch={number}"
                done = fs.Path(f"{path}/_SUCCESS")
                if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
                    part = history_view(fresh, unit, keys).withColumn("bucket_day", F.to_date("bucket"))
                    part.write.mode("overwrite").partitionBy("bucket_day").parquet(path)
            append_events(batch, history)
        finally:
            batch.unpersist()

    return run_batch


def stored_view(spark: SparkSession, views: str, name: str) -> DataFrame:
    """A view that history_batch keeps, its partial aggregates added up; filters of
    bucket_day skip partitions."""
    keys = VIEWS[name][1]
    columns = ["bucket timestamp", *(f"{k} string" for k in keys), "total_count long", "raw_bytes long", "last_seen timestamp", "run string", "batch long", "bucket_day date"]
    parts = spark.read.schema(", ".join(columns)).parquet(f"{views}/{name}")
    return merged(parts, ["bucket_day", "bucket", *keys])


def start(events: DataFrame, hot: str, checkpoint: str, trigger: dict | None = None, **sinks):
    """Write a stream to tables; ``trigger`` as for DataStreamWriter (default: all that is
    there, then stop)."""
    writer = events.writeStream.foreachBatch(store_batch(hot, **sinks)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def lagging(source: DataFrame, target: DataFrame) -> DataFrame:
    """Days of which a query copy holds fewer rows than its source: as a copy holds nothing
    else, days with equal counts are equal."""
    n = lambda t, c: t.groupBy(F.to_date("ingest_time").alias("day")).agg(F.count("*").alias(c))
    return n(source, "have").join(n(target, "there"), "day", "left").where("there is null or there < have").select("day")


def sync(source: DataFrame, target: str, late: timedelta | None = timedelta(days=2), limit: int = QUERY_LIMIT) -> int:
    """Copy what a query copy lacks, each row once. Rows up to the copy's mark, the
    (ingest_time, event_id) of its last row, are late ones: they are looked for by id, on
    the days whose counts differ. Later ones follow in pages, oldest first, each behind the
    mark of the one before, so a sync that is cut off goes on where it was. A page is as many
    whole days as have at most ``limit`` rows, or one day: days are counted once and read
    once each, of a table by ingest_day only their own files. ``late`` bounds how far back
    late rows are looked for; None: all of it. The number of rows copied."""
    spark, n = source.sparkSession, 0
    day = F.col("ingest_day") if "ingest_day" in source.columns else F.to_date("ingest_time")
    once = lambda rows: rows.dropDuplicates(["event_id"]) if "event_id" in source.columns else rows
    mark = None
    if exists(spark, target):
        copy = spark.read.parquet(target)
        last = copy.agg(F.max(F.struct("ingest_time", "event_id")).alias("m")).first()["m"]
        mark = (last[0], last[1]) if last is not None else None
    later = source
    if mark is not None:
        at, event = F.lit(mark[0]), F.lit(mark[1])
        old = (F.col("ingest_time") < at) | ((F.col("ingest_time") == at) & (F.col("event_id") <= event))
        later = source.where(~old & (day >= F.to_date(at)))
        if late is not None:
            old &= F.col("ingest_time") >= F.lit(mark[0] - late)
        days = [r[0] for r in lagging(once(source.where(old)), copy.where(old)).collect()]  # at most one for each day
        if days:
            n += append_events(source.where(old & day.isin(days)), target)
    counted = later.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day").collect()  # one row a day
    pages: list[list] = []
    room = 0
    for found in counted:
        if pages and found["n"] <= room:
            pages[-1].append(found["day"])
        else:
            pages.append([found["day"]])
            room = limit
        room -= found["n"]
    for days in pages:
        n += append_events(later.where(day.isin(days)), target)
    return n


def learn_batch(root: str, hot: str | None = None, **options):
    """A foreachBatch function, the learning loop over versioned state: the rules that are
    active fill the batch's events (stored in ``hot``, if given), what came of it adds to
    the counters of each rule, the batch's candidates add to the rules, ready ones become
    active, and those with too many failures or conflicts are rolled back. The state names
    the last batch in it, so one that comes again counts once; events are stored first."""
    from siftline.operators import learn
    from siftline.sources import sinks

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = sinks.latest_version(spark, root)
        if known and sinks.state(spark, root, "batches").agg(F.max("number")).first()[0] >= number:
            return
        old = sinks.state(spark, root, "rules") if known else spark.createDataFrame([], RULE)
        counted = sinks.state(spark, root, "counters") if known else spark.createDataFrame([], COUNTERS)
        batch = batch.withColumn("scope_key", source_scope(F.col("source_addr"))[0]).persist()
        filled_in = apply_learned(batch, learn.active_rules(old)).persist()
        try:
            if hot:
                append_events(filled_in, hot)
            counters = learn.summed(counted.union(learn.attributed(filled_in).select(counted.columns)))
            rules = learn.activated(learn.observed(old, learn.candidates(batch)), **options)
            numbers = spark.createDataFrame([(number,)], "number long")
            sinks.publish_state({"rules": learn.rolled_back(rules, counters), "counters": counters, "batches": numbers}, root)
        finally:
            filled_in.unpersist()
            batch.unpersist()

    return run
