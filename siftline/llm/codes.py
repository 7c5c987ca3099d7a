"""Token ids in a directly addressable file format.

An id is cut into levels of 8 bits. Level 0 holds the low chunk of every id; a
continuation bitmap tells which ids go on, and level k + 1 holds the next chunk of those
alone. A rank directory (ones before each block of 512 bits) finds an id's place in the
next level, so any token is read by a few lookups and no block is decoded.

Documents are range-partitioned by doc_id before they are tokenized. Each task writes
segments of whole documents as Parquet rows: first document and id numbers, the document
directory and, per level, chunks, bitmap and ranks. Spark's committer makes the files
safe against lost executors, and row-group statistics prune reads by id position.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import ship, work_dir
from siftline.llm.tokens import encoder, groups

SEGMENT = 1 << 18
BLOCK = 512
LEVELS = "array<struct<chunks: binary, goes_on: binary, ranks: binary>>"
FILE = f"part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, levels {LEVELS}"


def encode_levels(ids: np.ndarray) -> list[dict]:
    """The levels of uint32 ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        ones = np.add.reduceat(more, np.arange(0, max(len(rest), 1), BLOCK), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append(
            {
                "chunks": (rest & 255).astype(np.uint8).tobytes(),
                "goes_on": np.packbits(more, bitorder="little").tobytes(),
                "ranks": ranks.astype("<u4").tobytes(),
            }
        )
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


class Levels:
    """Reads ids from encoded levels by position."""

    def __init__(self, levels):
        self.levels = [
            (np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["goes_on"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels
        ]

    def at(self, i: int) -> int:
        """The id at position i, by one lookup per level that it has."""
        value = shift = 0
        for chunks, goes_on, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not goes_on[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            bits = np.unpackbits(goes_on[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(bits[: i - block * BLOCK].sum())
            shift += 8
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """Every id, in order."""
        n = len(self.levels[0][0])
        value, places = np.zeros(n, np.uint32), np.arange(n)
        for k, (chunks, goes_on, _) in enumerate(self.levels):
            value[places] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            places = places[np.unpackbits(goes_on, bitorder="little")[: len(places)].astype(bool)]
        return value


def _segments(kind: str, path: str, end_id: int, size: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(kind, path)
        docs, lengths, buffer, held = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(buffer), "<u4")
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": number, "n_ids": len(ids), "doc_ids": docs, "lengths": lengths, "levels": encode_levels(ids)}],
                schema=pa.schema(
                    [
                        ("part", pa.int32()),
                        ("segment", pa.int32()),
                        ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.list_(pa.int64())),
                        ("levels", pa.list_(pa.struct([(c, pa.binary()) for c in ("chunks", "goes_on", "ranks")]))),
                    ]
                ),
            )

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in groups(batch.column(1).to_pylist()):
                for ids in encode(texts):
                    docs.append(next(names))
                    lengths.append(len(ids) // 4 + 1)
                    buffer += ids, end
                    held += lengths[-1]
                    if held >= size:
                        yield row()
                        number += 1
                        docs, lengths, buffer, held = [], [], [], 0
        if docs:
            yield row()

    return run


def write_ids(docs: DataFrame, target: str, path: str, kind: str = "word", end_id: int = 1, segment: int = SEGMENT, partitions: int | None = None) -> str:
    """Write the ids of every document, in ascending doc_id order (null first), under
    ``target``. Null texts count as empty: the end id alone. Rows that repeat a doc_id
    follow each other in order of their text. A text of any length is encoded whole and
    stays in one segment. An empty table gives files without rows. Columns other than
    doc_id and text are not read."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(_segments(kind, path, end_id, segment), FILE)
        .write.mode("overwrite")
        .parquet(target)
    )
    return target


#: (part, segment, first) rows up to which a join may broadcast them: 24 MB
SENT = 1_000_000


def firsts(files: DataFrame) -> DataFrame:
    """(part, segment, n_ids, first): the number of ids before each segment. Sums per task
    are added up first, so the one ordered window has a row per written file."""
    sizes = files.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_first"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    return rows.select("part", "segment", "n_ids", (F.col("within") + F.col("part_first")).alias("first"))


def segments(spark: SparkSession, target: str) -> DataFrame:
    """The files' segments with ``first``; encoded ids don't move while there are few enough
    segments to send their numbers to all tasks."""
    files = spark.read.schema(FILE).parquet(target)
    places = firsts(files).select("part", "segment", "first")
    return files.join(F.broadcast(places) if files.count() <= SENT else places, ["part", "segment"])


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = Levels(row["levels"]).all().astype("<u4")
            starts = np.concatenate([[0], np.cumsum(row["lengths"])])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array((starts[:-1] + row["first"]).tolist(), pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return segments(spark, target).select("first", "doc_ids", "lengths", "levels").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _tokens(batches):
    for batch in batches:
        for row in batch.to_pylist():
            levels = Levels(row["levels"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["positions"], pa.int64()), pa.array([levels.at(p - row["first"]) for p in row["positions"]], pa.int64())],
                ["position", "id"],
            )


def tokens_at(spark: SparkSession, target: str, positions: list[int]) -> DataFrame:
    """(position, id) for a few positions in the whole corpus. Their segments, at most one
    for each, are found from the segments' sizes alone; only those are read, by filters on
    part and segment that prune row groups, and each id is looked up without decoding its
    neighbours. Positions outside the corpus give no rows."""
    ship(spark)
    files = spark.read.schema(FILE).parquet(target)
    wanted = F.filter(F.lit(list(positions)).cast("array<long>"), lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("n_ids")))
    found = firsts(files).withColumn("positions", wanted).where(F.size("positions") > 0).select("part", "segment", "first", "positions")
    found = spark.createDataFrame(found.collect(), found.schema)
    places = found.select("part", "segment").collect()
    here = F.col("part").isin([p for p, _ in places]) & F.col("segment").isin([s for _, s in places])
    return files.where(here).join(F.broadcast(found), ["part", "segment"]).select("first", "positions", "levels").mapInArrow(_tokens, "position long, id long")


def fresh_target(spark: SparkSession) -> str:
    import uuid

    return f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"
