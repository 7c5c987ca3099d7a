"""Best-fit packing of documents into fixed-length sequences.

Texts become ids where they are read; only piece lengths and checksums move. Pieces are
dealt by a hash of their document into groups of about GROUP pieces, and each group is
packed online: a fixed number of open bins, their free space in a bitset, each piece into
the bin that it fills best; when no more bins may open, the fullest one closes. A group
comes in slices of at most about SLICE pieces, by a hash, and a slice brings its longest
pieces first; a group of one slice is the same rule.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, lean, ship
from siftline.llm.tokens import LIMIT, encoder, groups, tables

CAPACITY = 1024
GROUP = 65536
SLICE = 8192
OPEN_BINS = 1024
#: texts of a batch, and about their characters, that are encoded together
ROWS, CHARS = 256, 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: only its first piece may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(kind: str, path: str, end_id: int, capacity: int, chunks: int = LIMIT):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(kind, path, chunks)
        # a batch of Arrow's holds 10,000 texts: only some of them become Python's at a time
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = iter(batch.column(0).to_pylist())
            for texts in groups(batch.column(1).to_pylist(), CHARS):
                out = [[] for _ in range(5)]
                for ids in encode(texts):
                    doc = next(rows)
                    ids += end
                    for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                        for column, x in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


class BestFit:
    """Online best fit with at most ``most`` open bins of ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: some open bin has f places free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
        self.open = self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset there) of a piece of 1..capacity."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self.bins[free].pop()
            if not self.bins[free]:
                self.free &= ~(1 << free)
            self.open -= 1
        else:
            free, at = self.capacity, self.next
            self.next += 1
        rest = free - length
        if rest:
            if self.open == self.most:
                fullest = (self.free & -self.free).bit_length() - 1
                if rest <= fullest:  # the bin just filled is the fullest
                    return at, self.capacity - free
                self.bins[fullest].pop()
                if not self.bins[fullest]:
                    self.free &= ~(1 << fullest)
                self.open -= 1
            self.bins[rest].append(at)
            self.free |= 1 << rest
            self.open += 1
        return at, self.capacity - free


def _pack(capacity: int, most: int):
    """Rows in order of their group; each group starts with no open bin."""

    def run(batches):
        group, bins = None, None
        for batch in batches:
            sequences, offsets = [], []
            for g, length in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if g != group:
                    group, bins = g, BestFit(capacity, most)
                at, offset = bins.place(length)
                sequences.append((g << 40) + at)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    path: str,
    kind: str = "spaced",
    end_id: int = 2,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    group: int = GROUP,
    chunks: int = LIMIT,
) -> DataFrame:
    """Pieces of every document with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed each
    on their own. A null doc_id stays null. A text of any length is encoded whole, in one
    task. ``chunks`` bounds a worker's table of distinct chunks: fewer take less memory and
    are segmented more often. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = cut(rows.mapInArrow(lean(_pieces(kind, path, end_id, capacity, chunks), tables(kind, path, chunks)), PIECES), "pieces")
    pieces_count = pieces.count()
    n_groups = max(1, -(-pieces_count // group))
    place = F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_groups)).alias("group")
    slices = max(1, -(-pieces_count // (n_groups * SLICE)))
    turn = F.pmod(F.xxhash64("start", "doc_id"), F.lit(slices))
    return (
        pieces.select(place, "*")
        .repartition(n_groups, "group")
        .sortWithinPartitions("group", turn, F.desc("length"), "doc_id", "start")
        .mapInArrow(_pack(capacity, open_bins), PIECES + ", sequence_id long, offset long")
    )
