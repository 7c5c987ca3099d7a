"""Joins of events with devices, CIDR rules and address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.net import cidr_bounds, ipv4_number, is_public, region_parts, small
from siftline.operators.parse import settled

WIDE = 64
ADDRESSES = 500_000
#: fixed values: the built-in rules, which come last; each is named by its network
DEFAULT_CIDRS = ["172.18.0.0/17", "172.28.128.0/19", "2.0.0.0/8"]


def device_key(devices: DataFrame) -> Column:
    return F.concat(F.lower("protocol"), F.lit("://"), F.col("host"), F.lit(":"), F.col("port").cast("string"))


def backfill_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    """device_id of the enabled device at an event's source; of two devices there the
    later id wins. Up to 100,000 devices are broadcast; more are joined by a shuffle."""
    known = devices.where("enabled").select(device_key(devices).alias("source_addr"), F.col("id").alias("_id"))
    known = small(known.groupBy("source_addr").agg(F.max("_id").alias("_id")))
    return events.join(known, "source_addr", "left").withColumn("device_id", F.coalesce("_id", "device_id")).drop("_id").select(events.columns)


def device_names(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Adds device_label: the name of the event's device, else its id, else its source."""
    names = small(devices.groupBy(F.col("id").alias("device_id")).agg(F.max("name").alias("_name")))
    return events.join(names, "device_id", "left").withColumn("device_label", F.coalesce("_name", "device_id", "source_addr")).drop("_name")


def device_rollup(devices: DataFrame, sources: DataFrame) -> DataFrame:
    """Managed devices with the metrics of their sources (host, or host and port); sources
    without a device stay as observed ones, devices without a source with zeros."""
    keys = F.explode(F.array_distinct(F.array("host", F.concat("host", F.lit(":"), F.col("port").cast("string"))))).alias("key")
    managed = devices.select(F.col("id"), F.col("name"), keys)
    seen = sources.withColumn("key", F.regexp_replace("source_addr", "^[a-z]+://", ""))
    rows = managed.join(seen, "key", "full")
    name = F.coalesce("name", "source_addr")
    rows = rows.groupBy(
        F.coalesce("id", "source_addr").alias("device"), name.alias("name"), F.when(F.col("id").isNull(), "observed").otherwise("managed").alias("kind")
    ).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "parsed", "partial", "failed", "raw_bytes")], F.max("last_seen").alias("last_seen")
    )
    return rows.orderBy(F.desc("total"), "device")


def new_events(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per event_id that is not stored yet."""
    return batch.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")


def cidr_names(ips: DataFrame, rules: DataFrame) -> DataFrame:
    """(ip, name): the first enabled rule (rule_order, cidr, name, enabled, deleted) whose
    network holds the address.

    A network's prefix lengths are few: the addresses are cut to each length that occurs
    and joined on equality, so the rules may be many and nothing is compared in pairs."""
    live = rules.where("enabled and not coalesce(deleted, false)")
    low, high = cidr_bounds(F.col("cidr"))
    live = live.select("rule_order", "name", low.alias("low"), (high - low + 1).alias("size")).where("low is not null")
    sizes = live.select("size").distinct()
    numbers = ips.select("ip", ipv4_number(F.col("ip")).alias("n")).where("n is not null").distinct()
    sized = numbers.join(sizes.agg(F.collect_set("size").alias("sizes")), F.lit(True))  # one row, at most 33 sizes
    cut = sized.select("ip", F.explode("sizes").alias("size"), "n").withColumn("low", F.col("n") - F.pmod("n", "size"))
    return cut.join(live, ["low", "size"]).groupBy("ip").agg(F.min_by("name", "rule_order").alias("name"))


def range_regions(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, region, province, city, isp) of public addresses by a table of ranges (ip_from,
    ip_to, region). Ranges are cut at the borders of 65,536 addresses and joined on those;
    ranges of more than WIDE such blocks go by their blocks of 16,777,216."""
    numbers = settled(ips.select("ip").distinct(), n=ipv4_number(F.col("ip"))).where(is_public(F.col("n")))
    blocks = F.shiftright("ip_to", 16) - F.shiftright("ip_from", 16) + 1

    def joined(part: DataFrame, bits: int) -> DataFrame:
        cut = part.withColumn("block", F.explode(F.sequence(F.shiftright("ip_from", bits), F.shiftright("ip_to", bits))))
        near = numbers.withColumn("block", F.shiftright("n", bits)).join(cut, "block")
        return near.where("n between ip_from and ip_to").select("ip", "ip_from", "ip_to", "region")

    found = joined(ranges.where(blocks <= WIDE), 16).union(joined(ranges.where(blocks > WIDE), 24))
    best = found.groupBy("ip").agg(F.max_by("region", "ip_from").alias("text"))  # the narrowest start
    region, province, city, isp = region_parts(F.col("text"))
    return best.select("ip", region.alias("region"), province.alias("province"), city.alias("city"), isp.alias("isp"))


def address_regions(ips: DataFrame, rules: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, region): a CIDR rule's name, else the range table's region."""
    named = cidr_names(ips, rules).withColumnRenamed("name", "rule_name")
    found = range_regions(ips, ranges).select("ip", "region")
    return named.join(found, "ip", "full").select("ip", F.coalesce("rule_name", "region").alias("region"))


def with_regions(events: DataFrame, rules: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds src_region, dst_region and geo_region. Only distinct addresses are looked up;
    up to ADDRESSES of them, and of those with a region, are broadcast, so that events are
    read twice and never shuffled."""
    ips = events.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct()
    regions = small(address_regions(small(ips, ADDRESSES), rules, ranges), ADDRESSES)
    out = events.join(regions.toDF("src_ip", "src_region"), "src_ip", "left").join(regions.toDF("dst_ip", "dst_region"), "dst_ip", "left")
    return out.withColumn("geo_region", F.coalesce("src_region", "dst_region"))


def pending_public_ips(events: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct public addresses without a region (known: ip)."""
    return pending_ips(events.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct(), known)


def pending_ips(ips: DataFrame, known: DataFrame) -> DataFrame:
    """The public ones of distinct addresses (ip) that ``known`` (ip) doesn't hold. The
    number is computed once for each: a filter would copy it into each of its bounds."""
    public = settled(ips.select("ip"), n=ipv4_number(F.col("ip"))).where(is_public(F.col("n"))).select("ip")
    return public.join(known.select("ip"), "ip", "left_anti")


def indexed_paths(index: DataFrame, day=None, source: str | None = None) -> list[str]:
    """Archives that an index lists for a day and source: what a scan has to open."""
    rows = index
    if day is not None:
        rows = rows.where(F.col("day") == F.lit(day))
    if source:
        rows = rows.where(F.col("source_addr").contains(source))
    return sorted(r[0] for r in rows.select("archive_path").distinct().collect())
