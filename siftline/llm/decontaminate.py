"""Benchmark decontamination by suffix arrays of the training texts.

The documents of an Arrow batch are one shard. Its suffix array holds the positions where
a benchmark window could begin (the first two words are those of some window), sorted by
the words from there on, as deep as the longest benchmark item goes. Every benchmark
suffix that begins a window is binary-searched in each shard, all suffixes together: the
range of its first words gives all locations, the neighbours of its place in that range
the longest verbatim match. The benchmark is searched in blocks of bounded size, so it may
grow; documents never move.

Words are runs of ASCII letters and digits and of characters beyond ASCII, after A-Z are
lower-cased; a word is known by 64 bits of its length and bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, lean, ship
from siftline.llm.jaccard_join import LOWER, MULTIPLIERS, Shingler, listed

WINDOW = 10
#: bytes of benchmark text that are searched together; one item may be larger
BLOCK = 32 << 20
FILTER_BITS = 22


class Words(Shingler):
    SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words in one array, a zero after each text, and where texts begin."""
        data = [(t or "").encode(errors="replace").translate(LOWER) for t in texts]
        at, h = self.words(b"\n".join(data)) if data else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        ends = np.searchsorted(at, np.cumsum([len(d) + 1 for d in data]))
        return np.insert(np.maximum(h, np.uint64(1)), ends, 0), np.concatenate([[0], ends + np.arange(1, len(data) + 1)]).astype(np.int64)


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in order of the words from there on; runs that are equal for
    ``depth`` words keep their order. ``words`` goes on for ``depth`` beyond the last."""
    order = at[np.argsort(words[at], kind="stable")]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = words[order[1:]] != words[order[:-1]]
    for d in range(1, depth):
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            break
        group = np.cumsum(new[:-1])[tied]
        there = order[tied]
        s = np.lexsort((words[there + d], group))
        order[tied] = there = there[s]
        w = words[there + d]
        differs = (w[1:] != w[:-1]) & (group[1:] == group[:-1])
        new[tied[1:][differs]] = True
    return order


class Suffixes:
    """The suffixes of a block of benchmark items that begin a window."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        words, begins = Words().of(texts)
        lengths = np.diff(begins) - 1
        self.ids = ids
        starts, items, offsets = [], [], []
        for i, (b, n) in enumerate(zip(begins.tolist(), lengths.tolist())):
            if n:
                k = max(n - window, 0) + 1
                starts.append(np.arange(b, b + k))
                items.append(np.full(k, i))
                offsets.append(np.arange(k))
        none = [np.zeros(0, np.int64)]
        self.at, self.item, self.offset = (np.concatenate(x or none) for x in (starts, items, offsets))
        self.left = lengths[self.item] - self.offset  # words from there to the item's end
        self.n = np.minimum(window, lengths[self.item])  # the window's
        self.depth = int(max(lengths, default=0)) + 1
        self.words = np.concatenate([words, np.zeros(self.depth, np.uint64)])
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        pair = self.at[self.n > 1]
        self.filter[self.cells(self.words[pair], self.words[pair + 1])] = True
        self.singles = np.unique(self.words[self.at[self.n == 1]])

    @staticmethod
    def cells(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return ((first * MULTIPLIERS[1] + second * MULTIPLIERS[2]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Positions of a shard where a window may begin."""
        may = self.filter[self.cells(words[:-1], words[1:])]
        if len(self.singles):
            may |= np.isin(words[:-1], self.singles)
        return np.flatnonzero(may & (words[:-1] != 0))

    def common(self, words: np.ndarray, p: np.ndarray, t: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words, at most ``most``, a shard's text at p shares with suffix t."""
        n = np.zeros(len(p), np.int64)
        go, d = np.flatnonzero(most > 0), 0
        while len(go):
            go = go[words[p[go] + d] == self.words[self.at[t[go]] + d]]
            d += 1
            n[go] = d
            go = go[most[go] > d]
        return n

    def bound(self, words, order, t, most, low, high, upper: bool) -> np.ndarray:
        """By binary search, for each suffix t, how many of order[low:high] come before it
        (or, upper, do not come after it), judged by the first ``most`` words."""
        low, high = low.copy(), high.copy()
        go = np.flatnonzero(low < high)
        while len(go):
            mid = (low[go] + high[go]) >> 1
            p, n = order[mid], most[go]
            same = self.common(words, p, t[go], n)
            a, b = words[p + np.minimum(same, n - 1)], self.words[self.at[t[go]] + np.minimum(same, n - 1)]
            before = np.where(same == n, upper, a < b)
            low[go] = np.where(before, mid + 1, low[go])
            high[go] = np.where(before, high[go], mid)
            go = go[low[go] < high[go]]
        return low

    def search(self, words: np.ndarray):
        """(order, t, low, high): the suffix array of a shard and, for each suffix whose
        window occurs, the range of its locations."""
        words = np.concatenate([words, np.zeros(self.depth, np.uint64)])
        order = suffix_array(words, self.candidates(words), self.depth)
        t = np.arange(len(self.at))
        zero = np.zeros(len(t), np.int64)
        low = self.bound(words, order, t, self.n, zero, zero + len(order), False)
        # few windows occur: the others are told by the word at their place
        some = np.flatnonzero(low < len(order))
        some = some[self.common(words, order[low[some]], t[some], self.n[some]) == self.n[some]]
        high = self.bound(words, order, some, self.n[some], low[some], zero[some] + len(order), True)
        return words, order, some, low[some], high

    def longest(self, words, order, t, low, high) -> tuple[np.ndarray, np.ndarray]:
        """The length and a location of each suffix's longest match: one of the two
        neighbours of its place."""
        place = self.bound(words, order, t, self.left[t], low, high, False)
        best, where = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for near in (place - 1, place):
            ok = np.flatnonzero((near >= low) & (near < high))
            p = order[near[ok]]
            n = self.common(words, p, t[ok], self.left[t[ok]])
            more = n > best[ok]
            best[ok[more]], where[ok[more]] = n[more], p[more]
        return best, where


def _located(suffixes: Suffixes, texts):
    """Of a shard: documents' first positions, the hit mark of each position, and the
    distinct (document, window) pairs with the suffixes of each window."""
    words, begins = Words().of(texts)
    padded, order, t, low, high = suffixes.search(words)
    marks = np.zeros(len(padded) + 1, np.int32)
    # equal windows have equal ranges: each is looked at once
    ranges, window = np.unique(np.stack([low, high, suffixes.n[t]]), axis=1, return_inverse=True)
    window = window.ravel()
    sizes = ranges[1] - ranges[0]
    p = order[np.repeat(ranges[0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    np.add.at(marks, p, 1)
    np.add.at(marks, p + np.repeat(ranges[2], sizes), -1)
    pairs = np.unique(np.stack([np.searchsorted(begins, p, side="right") - 1, np.repeat(np.arange(len(sizes)), sizes)]), axis=1)
    return begins, np.cumsum(marks) > 0, pairs, window, t


def _per_document(suffixes: Suffixes, texts):
    """(n_words, hit positions within the document, sorted ids of items) of each text."""
    begins, hit, pairs, window, t = _located(suffixes, texts)
    lengths = np.diff(begins) - 1
    by_window = np.argsort(window, kind="stable")
    edges = np.searchsorted(window[by_window], np.arange(window.max(initial=-1) + 2))
    item = suffixes.item[t[by_window]]
    known, cuts = {}, np.searchsorted(pairs[0], np.arange(len(texts) + 1))
    for i, (b, n) in enumerate(zip(begins.tolist(), lengths.tolist())):
        found = pairs[1, cuts[i] : cuts[i + 1]]
        if not len(found):
            yield n, np.zeros(0, np.int64), []
            continue
        key = found.tobytes()
        if key not in known:
            known[key] = sorted({suffixes.ids[j] for j in np.unique(np.concatenate([item[edges[w] : edges[w + 1]] for w in found.tolist()])).tolist()})
        yield n, np.flatnonzero(hit[b : b + n]), known[key]


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _report(suffixes):
    """Finished rows, for a benchmark of one block."""

    def run(batches):
        for batch in batches:
            rows = [(n, len(h), len(i), _digest(i)) for n, h, i in _per_document(suffixes.value, batch.column(1).to_pylist())]
            n, hits, items, digests = map(list, zip(*rows)) if rows else ([],) * 4
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in hits], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _parts(suffixes, first: bool):
    """Rows (row, n_words, hits, items) of what a block hits, for a benchmark of several;
    the first block gives all rows."""

    def run(batches):
        for batch in batches:
            rows = [(r, n, h, i) for r, (n, h, i) in zip(batch.column(0).to_pylist(), _per_document(suffixes.value, batch.column(1).to_pylist())) if first or len(h)]
            r, n, h, i = map(list, zip(*rows)) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(n, pa.int64()), listed(h), pa.array(i, pa.list_(pa.string()))], ["row", "n_words", "hits", "items"])

    return run


def _clean(suffixes, text: int):
    def run(batches):
        for batch in batches:
            fine = [not len(h) for _, h, _ in _per_document(suffixes.value, batch.column(text).to_pylist())]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return run


def _longest(suffixes):
    def run(batches):
        for batch in batches:
            s = suffixes.value
            words, begins = Words().of(batch.column(1).to_pylist())
            padded, order, t, low, high = s.search(words)
            n, p = s.longest(padded, order, t, low, high)
            doc = np.searchsorted(begins, p, side="right") - 1
            columns = [pa.array([s.ids[i] for i in s.item[t].tolist()], pa.string()), pa.array(s.offset[t]), pa.array(n), pa.array(high - low), batch.column(0).take(pa.array(doc)), pa.array(p - begins[doc])]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_word", "n_words", "n_locations", "doc_id", "doc_word"])

    return run


def blocks(benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK) -> list:
    """The benchmark's suffixes as broadcasts of about ``size`` bytes of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    out = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow()
        found = Suffixes(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), window)
        if len(found.at):
            out.append(spark.sparkContext.broadcast(found))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words. Rows that repeat a doc_id, or have none, each give
    a row; benchmark rows that repeat an item_id count as one item, and one without an id
    as the item of the empty string. Texts of any length are one shard of their own at
    most. An empty benchmark hits nothing, an empty table gives no rows; columns other than
    doc_id, item_id and text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    found, kind = blocks(benchmark, window, size), docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if not found:
        found = [spark.sparkContext.broadcast(Suffixes([], [], window))]
    if len(found) == 1:
        return rows.mapInArrow(lean(_report(found[0])), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = None
    for i, block in enumerate(found):
        part = rows.select("row", "text").mapInArrow(lean(_parts(block, i == 0)), "row long, n_words long, hits array<long>, items array<string>")
        parts = part if parts is None else parts.union(part)
    hits = F.array_distinct(F.flatten(F.collect_list("hits")))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    whole = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.size(hits).cast("long").alias("n_hit"), items.alias("items"))
    whole = whole.select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return rows.select("row", "doc_id").join(whole, "row").drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay."""
    ship(docs.sparkSession)
    for block in blocks(benchmark, window, size):
        docs = docs.mapInArrow(lean(_clean(block, docs.columns.index("text"))), docs.schema)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK) -> DataFrame:
    """For each item_id and item_word from which a window occurs: n_words of its longest
    verbatim match in all documents, n_locations of the window, and the doc_id and doc_word
    of one longest match (the smallest). Items with one id are told apart by text only."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id string, item_word long, n_words long, n_locations long, doc_id {kind}, doc_word long"
    parts = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, window, size):
        parts = parts.union(docs.select("doc_id", "text").mapInArrow(lean(_longest(block)), schema))
    best = F.min(F.struct(-F.col("n_words"), "doc_id", "doc_word")).alias("best")
    rows = parts.groupBy("item_id", "item_word").agg(F.sum("n_locations").alias("n_locations"), best)
    return rows.select("item_id", "item_word", (-F.col("best.col1")).alias("n_words"), "n_locations", "best.doc_id", "best.doc_word")
