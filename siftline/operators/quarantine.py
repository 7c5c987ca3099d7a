"""Quarantine of scopes whose lines go wrong, with growing holds and staged recovery.

A scope is in trouble in a bucket of time when its failures have too many shapes, come from
too many sources, or are too large a share of its lines. The bucket's end begins a hold, in
which learned rules don't apply. After it they apply to a growing share of lines, then to
all. Trouble during recovery begins a hold of twice the length, trouble after it one of the
first length; trouble during a hold changes nothing. The state is a function of the
buckets, so a replayed batch counts once and a late line changes what it should change.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.net import small
from siftline.operators.learn import fingerprint
from siftline.operators.parse import apply_learned
from siftline.sources.sinks import append_events, exists

#: fixed values: seconds of the first and of the longest hold
HOLD, LONGEST = 600, 86_400
#: shares of lines that rules apply to in the stages of recovery, and a stage's seconds
STAGES, STAGE = (0.25, 0.5), 300


def scope_health(parsed: DataFrame, unit: str = "minute", most: int = 200, least: int = 20, share: float = 0.25) -> DataFrame:
    """Per scope and bucket: total, failed, shapes and sources of failures, and whether the
    scope is in trouble. Equal event_ids count once. Counts are exact, and partial before
    they are shuffled."""
    bad = F.col("parse_status") == "failed"
    once = parsed.select("scope_key", F.date_trunc(unit, "ingest_time").alias("bucket"), "event_id", "source_addr", bad.alias("bad"), F.when(bad, fingerprint()).alias("shape"))
    lines = once.groupBy("scope_key", "bucket", "shape", F.when(F.col("bad"), F.col("source_addr")).alias("source")).agg(
        F.count_distinct("event_id").alias("total"), F.count_distinct(F.when(F.col("bad"), F.col("event_id"))).alias("failed")
    )
    rows = lines.groupBy("scope_key", "bucket").agg(
        F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.count_distinct("shape").alias("shapes"), F.count_distinct("source").alias("sources")
    )
    many = (F.col("shapes") > most) | (F.col("sources") > most)
    return rows.withColumn("trouble", many | ((F.col("total") >= least) & (F.col("failed") >= share * F.col("total"))))


def _intervals(hold: int, longest: int, stages: tuple, stage: int):
    """Sorted (scope_key, time of trouble in seconds) to intervals; holds a scope's state alone."""
    names = ["scope_key", "start", "stop", "share", "backoff"]

    def run(batches):
        out, scope, until, backoff = [], None, None, 0

        def recovery(cut):
            for i, part in enumerate(stages):
                a, b = until + i * stage, until + (i + 1) * stage
                if cut is None or a < cut:
                    out.append((scope, a, b if cut is None else min(b, cut), part, backoff))

        def rows():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names)

        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if until is not None and s != scope:
                    recovery(None)
                    until = None
                if until is not None and t < until:
                    continue
                again = until is not None and t < until + len(stages) * stage
                if until is not None:
                    recovery(t)
                scope, backoff = s, backoff + 1 if again else 0
                until = t + min(hold * 2 ** min(backoff, 40), longest)
                out.append((scope, t, until, 0.0, backoff))
            if len(out) > 5000:
                yield rows()
                out = []
        if until is not None:
            recovery(None)
        if out:
            yield rows()

    return run


def quarantine(health: DataFrame, unit: str = "minute", hold: int = HOLD, longest: int = LONGEST, stages: tuple = STAGES, stage: int = STAGE) -> DataFrame:
    """scope_key, start, stop, share, backoff: from ``start`` until before ``stop`` learned
    rules apply to that share of the scope's lines (0: held). Intervals of a scope don't
    overlap; outside of them rules apply to all lines. Only buckets in trouble move."""
    end = F.unix_timestamp(F.col("bucket") + F.expr(f"interval 1 {unit}"))
    rows = health.where("trouble").select("scope_key", end.alias("at")).repartition("scope_key").sortWithinPartitions("scope_key", "at")
    found = rows.mapInArrow(_intervals(hold, longest, stages, stage), "scope_key string, start long, stop long, share double, backoff int")
    return found.withColumn("start", F.timestamp_seconds("start")).withColumn("stop", F.timestamp_seconds("stop"))


def with_share(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds rule_share. Intervals are cut at full hours and joined on scope and hour, so a
    scope with many of them is not compared with each. Up to 100,000 scope-hours are
    broadcast: events are then read once and never shuffled."""
    hours = F.explode(F.sequence(F.date_trunc("hour", "start"), F.date_trunc("hour", "stop"), F.expr("interval 1 hour")))
    cut = intervals.select("scope_key", hours.alias("_hour"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("share").alias("_share"))
    held = small(cut.groupBy("scope_key", "_hour").agg(F.collect_list(F.struct("_start", "_stop", "_share")).alias("_held")))
    rows = events.withColumn("_hour", F.date_trunc("hour", "ingest_time")).join(held, ["scope_key", "_hour"], "left")
    fits = F.filter("_held", lambda i: (F.col("ingest_time") >= i["_start"]) & (F.col("ingest_time") < i["_stop"]))
    share = F.coalesce(F.array_min(F.transform(fits, lambda i: i["_share"])), F.lit(1.0))
    return rows.select(*events.columns, share.alias("rule_share"))


def apply_outside(events: DataFrame, rules: DataFrame, intervals: DataFrame) -> DataFrame:
    """What the learned rules make of events where their scopes' quarantine lets them: in a
    stage of recovery a share of events, picked by a hash of event_id."""
    rows = with_share(events, intervals)
    picked = F.conv(F.substring(F.sha2(F.col("event_id"), 256), 1, 4), 16, 10).cast("int") < F.col("rule_share") * 65536
    done = apply_learned(rows.where(picked).drop("rule_share"), rules)
    none = F.array().cast("array<string>")
    left = rows.where(~picked).drop("rule_share").withColumn("applied_rules", none).withColumn("failed_rules", none)
    return done.unionByName(left.select(done.columns))


def quarantine_batch(hot: str, health: str, unit: str = "minute", **guard):
    """A foreachBatch function: a batch goes to the hot table once, and the health of the
    days that it touches is counted again from there, so replays and late lines come out
    right. ``stored_quarantine`` reads the state."""

    def run(batch: DataFrame, number: int) -> None:
        from siftline.operators.parse import source_scope

        spark = batch.sparkSession
        days = [r[0] for r in batch.select(F.to_date("ingest_time").alias("d")).distinct().collect()]
        append_events(batch, hot)
        if days:
            stored = spark.read.parquet(hot).where(F.col("ingest_day").isin(days)).withColumn("scope_key", source_scope(F.col("source_addr"))[0])
            again = scope_health(stored, unit, **guard).withColumn("bucket_day", F.to_date("bucket"))
            again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_day").parquet(health)

    return run


def stored_quarantine(spark: SparkSession, health: str, unit: str = "minute", **holds) -> DataFrame:
    rows = spark.read.parquet(health) if exists(spark, health) else spark.createDataFrame([], "scope_key string, bucket timestamp, trouble boolean")
    return quarantine(rows, unit, **holds)


def quarantined(intervals: DataFrame, as_of) -> DataFrame:
    """Scopes that are held or recovering at a time: scope_key, share, until, backoff."""
    at = F.lit(as_of)
    return intervals.where((F.col("start") <= at) & (at < F.col("stop"))).select("scope_key", "share", F.col("stop").alias("until"), "backoff")
