import datetime as dt

from pyspark.sql import functions as F

from siftline.functions import net
from siftline.operators import parse

T0 = dt.datetime(2026, 5, 15, 1, 20)
ARROW = parse.ParseRule(
    "Arrow", 10, r"\[edge\] (?P<src>[0-9.]+) -> (?P<dst>[0-9.]+) (?P<act>[A-Z]+)", [("src_ip", "src", None), ("dst_ip", "dst", None), ("action", "act", None)]
)
LINES = [
    "Sangfor: src=9.1.1.1 dst=9.2.2.2 proto=17 action=permit",
    "Sangfor: src=9.1.1.1",  # the vendor's is partial, so is the generic one
    "Sangfor: source=9.1.1.1 dest=9.2.2.2 act=permit",  # only the generic parser reads these keys
    "Sangfor [edge] 9.1.1.1 -> 9.2.2.2 DROP",  # only the rule fits
    "sport=70000 src='9.1.1.1' dst=\"9.2.2.2\" prot=6",
    "源地址=9.1.1.1 目标地址=9.2.2.2 动作=permit",
    "x=1 [edge] 9.1.1.1 -> 9.2.2.2 DROP",
    "src=9.1.1.1 note='",
    "nothing here", "", None,
]


def rows(spark):
    return spark.createDataFrame([(T0, "udp://10.9.8.7:514", x) for x in LINES], "ingest_time timestamp, source_addr string, raw string")


def test_parsers_left_out_change_nothing(spark):
    """Without diagnostics a parser runs only where none before it parsed."""
    for rules in ([], [ARROW]):
        whole = parse.parse_events(rows(spark), rules=rules, diagnostics=True).drop("attempts", "matched_parser")
        short = parse.parse_events(rows(spark), rules=rules)
        assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect()))
    by = {r.raw: r for r in short.collect()}
    assert [by[x].parse_status for x in LINES] == ["parsed", "partial", "parsed", "parsed", "parsed", "parsed", "parsed", "partial", "failed", "failed", "failed"]
    assert (by[LINES[0]].vendor, by[LINES[2]].vendor, by[LINES[3]].vendor) == ("Sangfor", None, "Arrow")
    assert (by[LINES[4]].src_ip, by[LINES[4]].src_port, by[LINES[4]].protocol) == ("9.1.1.1", None, "TCP")
    assert (by[LINES[5]].src_ip, by[LINES[5]].dst_ip, by[LINES[5]].action) == ("9.1.1.1", "9.2.2.2", "permit")


def test_settled_replaces_columns(spark):
    done = parse.settled(spark.range(2), id=F.col("id") + 1, other=F.struct(F.col("id").alias("a")))
    assert [(r.id, r.other.a) for r in done.collect()] == [(1, 0), (2, 1)]
    assert parse.settled(spark.range(0), x=F.lit(1)).count() == 0


def test_sizes(spark):
    sizes = spark.createDataFrame([(n,) for n in (None, 0, 1023, 1024, 1280, 1023 * 1024 + 512, 5 * 1024**4)], "n long")
    assert [r.s for r in sizes.select(net.byte_size(F.col("n")).alias("s")).collect()] == ["0 B", "0 B", "1023 B", "1.0 KB", "1.3 KB", "1023.5 KB", "5120.0 GB"]
