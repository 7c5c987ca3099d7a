"""Queries that use events several times parse each line once for each tier they search."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.operators import learn, parse, search
from siftline.plans import queries, stores
from siftline.plans.lines import ARROW, lines

SF = "/root/testdata/sf0.001"


def parsed_rows(spark, monkeypatch, name: str) -> float:
    """How many times over a query parses the lines."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def events(spark, sf_dir, **more):
        rows = lines(spark, sf_dir)
        return parse.parse_events(rows.mapInArrow(count, rows.schema), rules=[ARROW], **more)

    monkeypatch.setattr(queries, "events", events)
    monkeypatch.setattr(stores, "events", events)
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    return made.value / lines(spark, SF).count()


def test_learn_rollback_parses_once(spark, monkeypatch):
    assert parsed_rows(spark, monkeypatch, "learn_rollback") == 1


def test_attribution_takes_events_with_one_list(spark):
    rows = [("parsed", ["a"], None), ("partial", ["a", "b"], ["c"]), ("failed", None, ["a"]), ("failed", [], [])]
    got = learn.attributed(spark.createDataFrame(rows, "parse_status string, applied_rules array<string>, failed_rules array<string>"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 2, 1), ("b", 1, 1, 0), ("c", 1, 1, 1)}


def test_unified_search_parses_once(spark, monkeypatch):
    assert parsed_rows(spark, monkeypatch, "unified_search") == 3


@pytest.mark.parametrize("limit", [3, 4, 7, 40, 100])
def test_a_large_limit_sends_few_rows_to_one_task(spark, monkeypatch, limit):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 2, None if i % 3 else f"p{i % 6}", None if i == 5 else t0 + dt.timedelta(minutes=37 * (i % 11)), f"{i:03d}") for i in range(60)]
    table = spark.createDataFrame(rows, "tier_rank int, archive_path string, ingest_time timestamp, event_id string")
    keys = ["tier_rank", "archive_path"]
    want = table.orderBy("tier_rank", F.asc_nulls_first("archive_path"), F.desc("ingest_time"), F.desc("event_id")).limit(limit).collect()
    monkeypatch.setattr(search, "TOP_ROWS", 3)
    got = search.first_rows(table, keys, limit)
    assert got.collect() == want
    assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == (limit > 3)
    assert search.newest(table, limit).collect() == table.orderBy(F.desc("ingest_time"), F.desc("event_id")).limit(limit).collect()


def test_tier_search_dedup_parses_once(spark, monkeypatch):
    assert parsed_rows(spark, monkeypatch, "tier_search_dedup") == 2


def test_quarantine_apply_parses_once(spark, monkeypatch):
    assert parsed_rows(spark, monkeypatch, "quarantine_apply") == 1


def test_storage_stats_parses_once(spark, monkeypatch):
    assert parsed_rows(spark, monkeypatch, "storage_stats") == 1


def test_pending_public_ips_parses_once(spark, monkeypatch):
    assert parsed_rows(spark, monkeypatch, "pending_public_ips") == 1
