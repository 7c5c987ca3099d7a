"""Product codes of vectors, with LAESA pivots in front of exact integer distances.

Components become integers and vectors are cut into parts. Each part position has a
codebook and a few fixed pivots, chosen far apart among its first entries. The distances of
every part to its pivots are computed once and written with the integers. In each round
only the entries' distances to the pivots are new: by the triangle inequality
|d(part, pivot) - d(entry, pivot)| bounds d(part, entry) from below. The entry of least
bound is evaluated first, the next ones tighten the best distance, and only entries whose
bound does not exceed it are evaluated at all. Evaluations are exact, ties go to the lower
index, so codes are those of a full search.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, lean, ship

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 4, 256, 4, 12, 1024
ROWS = 2048
#: labels whose totals are joined by a broadcast; of more, the frequent ones
LABELS = 100_000


def largest(size: int) -> int:
    """Integers are kept within this bound, so that every error fits into a long."""
    return math.isqrt((1 << 63) // (4 * max(size, 1))) - 1


def bounds(size: int) -> list[int]:
    """Where parts begin and end; sizes that can't be cut evenly give parts that differ by one."""
    return [i * size // PARTS for i in range(PARTS + 1)]


def integers(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their floor(SCALE * component)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    fits = np.flatnonzero(lengths == size)
    flat = lists.take(pa.array(fits)).flatten().cast(pa.float64())
    x = np.asarray(flat.fill_null(np.nan)).reshape(-1, size)
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return fits[fine], np.clip(np.floor(SCALE * x[fine]), -largest(size), largest(size)).astype(np.int64)


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Entries, each the farthest from those before it; the first is the first."""
    chosen, d = [0], squared(entries, entries[:1])
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, squared(entries, entries[chosen[-1:]]))
    return entries[chosen]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Codebook:
    """The entries of one part position, in the narrowest type in which squared distances
    to parts within ``most`` are exact."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray, most: int):
        top = max(most, int(np.abs(entries).max(initial=0)))
        worst = entries.shape[1] * (2 * top) ** 2
        self.kind = np.float32 if worst <= 1 << 24 else np.float64 if worst <= 1 << 53 else np.int64
        self.entries = entries.astype(self.kind)
        self.reach = np.stack([to_pivot(entries, p) for p in pivots])  # pivot, entry
        self.evaluated = 0

    def nearest(self, parts: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry; ``reach``: distances of
        parts to pivots, by part."""
        codes, best = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for a in range(0, len(parts), ROWS):
            codes[a : a + ROWS], best[a : a + ROWS] = self._some(parts[a : a + ROWS].astype(self.kind), reach[a : a + ROWS])
        return codes, best

    def _some(self, x: np.ndarray, reach: np.ndarray):
        low = np.zeros((len(x), len(self.entries)), np.float32)
        for h, entry in enumerate(self.reach):
            np.maximum(low, np.abs(reach[:, h, None] - entry), out=low)
        # what single precision may have added
        slack = np.float32(4e-7) * (reach.max(axis=1) + self.reach.max())
        low -= slack[:, None]
        rows = np.arange(len(x))
        first = low.argmin(axis=1)
        best = squared(x, self.entries[first])
        # the next nearest by their bounds make the best one small before the rest is looked at
        if low.shape[1] > 8:
            r, e = np.repeat(rows, 8), np.argpartition(low, 8, axis=1)[:, :8].ravel()
            best = np.minimum(best, squared(x[r], self.entries[e]).reshape(-1, 8).min(axis=1))
        limit = np.sqrt(best.astype(np.float64)) * (1 + 1e-6) + 1e-6
        r, e = np.nonzero(low <= limit[:, None].astype(np.float32))
        d = squared(x[r], self.entries[e])
        self.evaluated += len(d)
        edge = np.searchsorted(r, rows)
        best = np.minimum.reduceat(d, edge)
        hit = np.flatnonzero(d == best[r])  # in order of entries within a row
        return e[hit[np.searchsorted(r[hit], rows)]], best.astype(np.int64)


def to_pivot(parts: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    d = parts.astype(np.float64) - pivot
    return np.sqrt(np.einsum("ij,ij->i", d, d)).astype(np.float32)


def _measured(size: int, pivots: list[np.ndarray], keep: int):
    """(columns that are kept, ints, reach) of the rows that take part."""

    def run(batches):
        for batch in batches:
            rows, x = integers(batch.column(keep), size)
            at = bounds(size)
            reach = np.concatenate([np.stack([to_pivot(x[:, at[i] : at[i + 1]], p) for p in pivots[i]], axis=1) for i in range(PARTS)], axis=1)
            held = [batch.column(i).take(pa.array(rows)) for i in range(keep)]
            ints = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel()))
            far = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * reach.shape[1]), pa.array(reach.ravel()))
            yield pa.RecordBatch.from_arrays([*held, ints, far], [*batch.schema.names[:keep], "ints", "reach"])

    return run


def _arrays(batch, size: int, pivots):
    x = np.asarray(batch.column(batch.schema.get_field_index("ints")).flatten()).reshape(-1, size)
    reach = np.asarray(batch.column(batch.schema.get_field_index("reach")).flatten()).reshape(len(x), -1)
    at, far = bounds(size), np.cumsum([0, *map(len, pivots)])
    return [(x[:, at[i] : at[i + 1]], reach[:, far[i] : far[i + 1]]) for i in range(PARTS)]


def _books(entries, pivots, parts):
    return [Codebook(e, p, int(np.abs(x).max(initial=0))) for e, p, (x, _) in zip(entries, pivots, parts)]


def _sums(size: int, entries: list[np.ndarray], pivots: list[np.ndarray]):
    """Per part and entry of a task: how many parts it got and the sums of their components."""

    def run(batches):
        counts = [np.zeros(len(e), np.int64) for e in entries]
        sums = [np.zeros(e.shape, np.int64) for e in entries]
        for batch in batches:
            parts = _arrays(batch, size, pivots)
            for i, (book, (x, reach)) in enumerate(zip(_books(entries, pivots, parts), parts)):
                codes, _ = book.nearest(x, reach)
                by = np.argsort(codes, kind="stable")
                used, first = np.unique(codes[by], return_index=True)
                counts[i] += np.bincount(codes, minlength=len(counts[i]))
                if len(used):
                    sums[i][used] += np.add.reduceat(x[by], first, axis=0)
        for i in range(PARTS):
            used = np.flatnonzero(counts[i])
            columns = [pa.array(np.full(len(used), i)), pa.array(used), pa.array(counts[i][used]), pa.array([*sums[i][used]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def _codes(size: int, entries, pivots, keep: int):
    def run(batches):
        for batch in batches:
            parts = _arrays(batch, size, pivots)
            found = [book.nearest(x, reach) for book, (x, reach) in zip(_books(entries, pivots, parts), parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], [*batch.schema.names[:keep], "code", "error"])

    return run


class VectorCodes:
    """Codebooks of a table of vectors. ``codes()`` gives its rows' other columns with
    code and error; ``entries`` are the final codebooks, one array for each part."""

    def __init__(self, vectors: DataFrame, column: str = "embedding", order: str = "vec_id", rounds: int = ROUNDS):
        ship(vectors.sparkSession)
        x = F.col(column)
        bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & ~bad)
        first = kept.orderBy(F.col(order).asc_nulls_last(), column).limit(1).select(F.size(x)).collect()
        self.others = [c for c in vectors.columns if c != column]
        self.size, self.entries = (first[0][0] if first else 0), None
        if not first:
            return
        head = kept.where(F.size(x) == self.size).orderBy(F.col(order).asc_nulls_last(), column).limit(ENTRIES).select(column).toArrow()
        _, start = integers(head.column(0), self.size)
        at = bounds(self.size)
        self.entries = [start[:, at[i] : at[i + 1]] for i in range(PARTS)]
        self.pivots = [far_apart(e, PIVOTS) for e in self.entries]
        rows = vectors.select(*self.others, column)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != column)
        self.kinds = f"{kinds}, " if kinds else ""
        self.rows = cut(rows.mapInArrow(lean(_measured(self.size, self.pivots, len(self.others))), f"{self.kinds}ints array<long>, reach array<float>"), "measured")
        for _ in range(rounds):
            self.round()

    def round(self) -> None:
        """One assignment, and each entry moved to its parts' floor of the mean. The driver
        gets one row for each component of each entry."""
        moved = self.rows.select("ints", "reach").mapInArrow(lean(_sums(self.size, self.entries, self.pivots)), "part long, entry long, n long, sums array<long>")
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
        totals = moved.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(exact("n"), exact("x"))
        for row in totals.collect():
            self.entries[row["part"]][row["entry"], row["at"]] = int(row["x"]) // int(row["n"])

    def codes(self) -> DataFrame:
        return self.rows.mapInArrow(lean(_codes(self.size, self.entries, self.pivots, len(self.others))), f"{self.kinds}code string, error long")

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def with_totals(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal keys, null ones together; null where it
    passes a long. Up to LABELS keys are broadcast; of more, those with many rows are, and
    the rest is joined by a shuffle, so a key with most of the rows is never one task."""
    total = F.expr(f"try_cast(sum(cast(`{value}` as decimal(20,0))) as long)")
    sums = cut(rows.groupBy(F.col(key).alias("_key")).agg(total.alias(name), F.count("*").alias("_n")), "totals")
    n = sums.count()
    same = F.col(key).eqNullSafe(F.col("_key"))
    if n <= LABELS:
        return rows.join(F.broadcast(sums.drop("_n")), same, "left").drop("_key")
    share = (sums.agg(F.sum("_n")).first()[0] or 0) / LABELS
    many, few = sums.where(F.col("_n") > share).drop("_n"), sums.where(F.col("_n") <= share).drop("_n")
    hot = rows.join(F.broadcast(many), same, "inner").drop("_key")
    rest = rows.join(F.broadcast(many.select("_key")), same, "left_anti")
    return hot.unionByName(rest.join(few, same, "inner").drop("_key"))


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part.

    Vectors that are null, empty or hold null or non-finite components are left out, and so
    are those of another length than the one of the smallest vec_id (null ids come last).
    Fewer than 256 vectors give so many entries. Components beyond largest(length), about
    2**27 for 64, are taken as that bound, as no error would fit a long beyond it. Rows
    that repeat a vec_id each take part. An empty table gives no rows; columns other than
    vec_id, label and the vectors are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col(column).alias("embedding"))
    book = VectorCodes(rows)
    if book.entries is None:
        kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(book.codes(), "codes")
    out = with_totals(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
