"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. A chunk's hash is a polynomial in a fixed
base modulo each of two primes; hashes combine by H(ab) = H(a) * base**len(b) + H(b).
Ordinary texts are hashed where they are read. The chunks of huge texts are dealt to all
tasks, and their hashes, shifted by what follows them, are summed by Spark. Texts with
equal fingerprints are then compared chunk by chunk: per fingerprint and chunk number
Spark keeps the least and the greatest chunk, before and after the shuffle, and two
different ones show a collision, which splits the group by content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bits_for, bloom_hit, bloom_words, cut, lean, ship

CHUNK = 1 << 15
HUGE = 1 << 20
#: primes below 2**31 and a base for each
MODULI = ((2147483647, 1103515245), (2147483629, 1566083941))
KEY = ["n_bytes", "fp1", "fp2"]


class Polynomial:
    """Hashes of byte strings modulo a prime below 2**31, composable by shift."""

    def __init__(self, prime: int, base: int, chunk: int = CHUNK):
        self.prime, self.base, self.chunk = prime, base % prime, chunk
        powers = [1]
        for _ in range(chunk - 1):
            powers.append(powers[-1] * self.base % prime)
        self.powers = np.array(powers[::-1], dtype=np.uint64)

    def of_chunk(self, data: np.ndarray) -> int:
        """data: uint64 values 1..256, at most ``chunk`` of them (no overflow: 2**54)."""
        return int(np.dot(data, self.powers[self.chunk - len(data) :])) % self.prime

    def combine(self, left: int, right: int, right_length: int) -> int:
        return (left * pow(self.base, right_length, self.prime) + right) % self.prime

    def of(self, data: np.ndarray) -> int:
        h = 0
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            h = self.combine(h, self.of_chunk(part), len(part))
        return h


def values(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)


def _whole(moduli, key):
    """Rows (key, text) to (key, n_bytes, fp1, fp2, text_sha256)."""

    def run(batches):
        hashers = [Polynomial(*m) for m in moduli]
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                v = values(data)
                out.append((len(data), *(h.of(v) for h in hashers), hashlib.sha256(data).hexdigest()))
            n, a, b, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())],
                [key, *KEY, "text_sha256"],
            )

    return run


def _pieces(chunk: int):
    """Rows (key, text) to (key, sha, n_bytes, bytes that follow the piece, piece)."""

    def run(batches):
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                sha = hashlib.sha256(data).hexdigest()
                for at in range(0, len(data), chunk):
                    part = data[at : at + chunk]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([sha]), pa.array([len(data)], pa.int64()), pa.array([len(data) - at - len(part)], pa.int64()), pa.array([part], pa.binary())],
                        ["row", "text_sha256", "n_bytes", "after", "piece"],
                    )

    return run


def _shifted(moduli):
    def run(batches):
        hashers = [Polynomial(*m) for m in moduli]
        for batch in batches:
            terms = [[], []]
            for piece, after in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist()):
                v = values(piece)
                for h, out in zip(hashers, terms):
                    out.append(h.of(v) * pow(h.base, after, h.prime) % h.prime)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(t, pa.int64()) for t in terms)],
                ["row", "text_sha256", "n_bytes", "t1", "t2"],
            )

    return run


def fingerprints(docs: DataFrame, moduli=MODULI, huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, fp1, fp2, text_sha256) of every row; null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small = rows.where(F.octet_length("text") <= huge).mapInArrow(
        lean(_whole(moduli, "doc_id")), "doc_id long, n_bytes long, fp1 long, fp2 long, text_sha256 string"
    )
    # a huge text keeps its row's identity in (doc_id, hash of the text), through the shuffle of its pieces
    pieces = rows.where(F.octet_length("text") > huge).mapInArrow(
        _pieces(CHUNK * 8), "row long, text_sha256 string, n_bytes long, after long, piece binary"
    )
    terms = pieces.repartition(F.xxhash64("row", "after")).mapInArrow(
        _shifted(moduli), "row long, text_sha256 string, n_bytes long, t1 long, t2 long"
    )
    copies = F.sum("t1"), F.sum("t2")
    n = F.ceil(F.col("n_bytes") / (CHUNK * 8))
    large = (
        terms.groupBy("row", "text_sha256", "n_bytes")
        .agg(copies[0].alias("s1"), copies[1].alias("s2"), F.count("*").alias("k"))
        # rows that repeat a huge document bring its pieces as often as the row stands there
        .withColumn("times", (F.col("k") / n).cast("int"))
        .withColumn("each", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(
            F.col("row").alias("doc_id"),
            "n_bytes",
            F.expr(f"pmod(s1 div times, {moduli[0][0]})").alias("fp1"),
            F.expr(f"pmod(s2 div times, {moduli[1][0]})").alias("fp2"),
            "text_sha256",
        )
    )
    return small.union(large)


def _chunks(moduli, chunk):
    """Rows (n_bytes, fp1, fp2, text) to one row per chunk."""

    def run(batches):
        for batch in batches:
            keys = [c.to_pylist() for c in batch.columns[:3]]
            for n, a, b, text in zip(*keys, batch.column(3).to_pylist()):
                data = text.encode()
                cuts = range(0, max(len(data), 1), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * len(cuts), pa.int64()) for x in (n, a, b)]
                    + [pa.array(range(len(cuts)), pa.int64()), pa.array([data[i : i + chunk] for i in cuts], pa.binary())],
                    [*KEY, "chunk_no", "chunk"],
                )

    return run


def _with_text(moduli):
    def run(batches):
        hashers = [Polynomial(*m) for m in moduli]
        for batch in batches:
            prints = []
            for text in batch.column(0).to_pylist():
                v = values(text.encode())
                prints.append((len(v), *(h.of(v) for h in hashers)))
            columns = zip(*prints) if prints else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), batch.column(0)],
                [*KEY, "text"],
            )

    return run


def exact_dedup(docs: DataFrame, moduli=MODULI, huge: int = HUGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, code point by code point; the row with the largest
    doc_id of equal texts is kept. A null text counts as empty, and empty texts form one
    group. A null doc_id is smaller than any other. Where rows repeat the largest doc_id,
    one of them is kept. An empty table gives no rows. Columns other than doc_id and text
    are not read.
    """
    ship(docs.sparkSession)
    prints = cut(fingerprints(docs, moduli, huge).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = cut(prints.groupBy(*KEY).agg(best, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    key = F.struct(*KEY)
    log2_bits = bits_for(groups.count())
    words = bloom_words(groups, key, log2_bits)
    again = (
        docs.select(F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(lean(_with_text(moduli)), "n_bytes long, fp1 long, fp2 long, text string")
        .where(bloom_hit(words, key, log2_bits))
        .mapInArrow(lean(_chunks(moduli, CHUNK * 8)), "n_bytes long, fp1 long, fp2 long, chunk_no long, chunk binary")
    )
    clash = cut(
        again.groupBy(*KEY, "chunk_no")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .where("low <> high")
        .select(*KEY)
        .distinct(),
        "collisions",
    )
    if clash.isEmpty():
        joined = prints.join(groups, KEY, "left")
    else:
        # different texts under one fingerprint: their groups are told apart by content
        marked = prints.join(clash.withColumn("clash", F.lit(True)), KEY, "left")
        marked = marked.withColumn("content", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit("")))
        prints = cut(marked, "marked")
        parts = [*KEY, "content"]
        groups = cut(prints.groupBy(*parts).agg(best, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
        joined = prints.join(groups, parts, "left")
    mine = F.struct("doc_id", "row")
    return joined.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("best").isNull() | mine.eqNullSafe(F.col("best"))).alias("kept"),
        "text_sha256",
    )
