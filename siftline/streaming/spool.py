"""A stream over spool segments: lines that a collector wrote ahead, in order.

A segment is a file of JSON records with an offset each; ``.open`` ones still grow,
``.sealed`` ones don't. The stream's position is (segment, offset). When a batch is stored,
Spark's checkpoint has its end and tells the source, which renames the sealed segments
before it to ``.committed``. A stop between the two loses nothing: the position is in the
checkpoint, and the events' ids keep a batch that comes again from counting twice.
"""

from __future__ import annotations

import datetime as dt
import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siftline.operators.parse import parse_events
from siftline.schema import SPOOL
from siftline.sources.archives import located

LIVE, STATES = (".open", ".sealed"), (".open", ".sealed", ".committed")


def _segments(path: str, states=STATES) -> list[tuple[str, str]]:
    """(name without its state, state) in order."""
    system, root = located(path)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]
    return sorted((n[: -len(s)], s) for n in names for s in states if n.endswith(s))


def _records(path: str, segment: str):
    """(offset, record) of the whole lines of a segment, whatever state it is in by now."""
    system, root = located(path)
    for state in STATES:
        try:
            stream = system.open_input_stream(f"{root}/{segment}{state}", compression=None)
            break
        except FileNotFoundError:
            continue
    else:
        return
    rest = b""
    with stream:
        while chunk := stream.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if line.strip():
                    record = json.loads(line)
                    yield record["offset"], record


class Range(InputPartition):
    def __init__(self, path: str, segment: str, after: int, upto: int | None):
        self.path, self.segment, self.after, self.upto = path, segment, after, upto


class SpoolStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]

    def initialOffset(self):
        return {"segment": "", "offset": -1}

    def latestOffset(self):
        found = _segments(self.path)
        for segment, _ in reversed(found):
            last = max((n for n, _ in _records(self.path, segment)), default=None)
            if last is not None:
                return {"segment": segment, "offset": last}
        return self.initialOffset()

    def partitions(self, start, end):
        out = []
        for segment in sorted({s for s, _ in _segments(self.path)}):
            if start["segment"] <= segment <= end["segment"]:
                out.append(Range(self.path, segment, start["offset"] if segment == start["segment"] else -1, end["offset"] if segment == end["segment"] else None))
        return out

    def read(self, partition):
        for offset, record in _records(partition.path, partition.segment):
            if offset > partition.after and (partition.upto is None or offset <= partition.upto):
                yield offset, dt.datetime.fromisoformat(record["ingest_time"].replace("Z", "+00:00")), record["source_addr"], record["raw"]

    def commit(self, end):
        """Sealed segments of which everything is stored are renamed."""
        system, root = located(self.path)
        for segment, state in _segments(self.path, (".sealed",)):
            last = max((n for n, _ in _records(self.path, segment)), default=-1)
            if (segment, last) <= (end["segment"], end["offset"]):
                system.move(f"{root}/{segment}{state}", f"{root}/{segment}.committed")


class Spool(DataSource):
    @classmethod
    def name(cls):
        return "spool"

    def schema(self):
        return SPOOL

    def streamReader(self, schema):
        return SpoolStream(self.options)


def spool_stream(spark: SparkSession, path: str, **parse) -> DataFrame:
    """Events of a spool as they come."""
    spark.dataSource.register(Spool)
    return parse_events(spark.readStream.format("spool").load(path).drop("offset"), **parse).drop("scope_key")


def cleanup(path: str) -> int:
    """Delete committed segments but the last, whose name tells where the stream stands."""
    system, root = located(path)
    done = _segments(path, (".committed",))
    live = _segments(path, LIVE)
    gone = done if live else done[:-1]
    for segment, state in gone:
        system.delete_file(f"{root}/{segment}{state}")
    return len(gone)
