"""Exact n-gram Jaccard join in the metric space of shingle sets.

1 - Jaccard is a metric, so pivots, regions and triangle windows give exact answers. Its
one weakness is that sets without a common shingle are all at distance 1 from each other,
where no pivot separates anything. The space is therefore first cut into blocks: sets that
link must share a shingle among their first n - ceil(3n/4) + 1 in a common order (rarest
first, by a count sketch over all documents that is sized by the input). In each block:

1. The block's pivot is its most central member: the one that meets most others over all of
   its blocks. A document belongs to the Voronoi cell of one of
   its blocks' pivots, the one that it shares most blocks with, and its distance to that
   pivot is found (first bounded by what short codes of their prefixes share, then exactly
   where a link is possible). Links join components. A block whose members are of one
   component is done; otherwise the members of the pivot's component are its region and
   need no comparison among themselves.
2. By the triangle inequality a member x outside can only link with region members y of
   d(y, pivot) >= d(x, pivot) - radius: that window, and what has no known distance, stays
   with the outside; the rest of the region leaves the block. Most blocks end here.
3. What is left recurs with a new pivot from outside, until the pairs that are left are
   few; those are filtered by component, size, position and triangle window and compared.

Equal sets are one point of the space: they are collapsed first and only their smallest
doc_id takes part. Nothing is capped: large blocks are cut into cells that meet pairwise.
How many levels recur, and when the pairs that are left count as few, changes the cost and
not the result, as do the sizes of the sketch and of the filters.

A word is known by 64 bits and a shingle by 64 mixed bits of its words' in order.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch, bits_for, bloom_hit, bloom_words, components, lean, ship

#: log2 of the sketch's cells, and the parts in which it is added up
LEAST_SKETCH, MOST_SKETCH = 12, 24
SKETCH_PARTS = 64
CELL = 512
RADIUS = 0.25
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: odd multipliers of the words of a shingle
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)
SAME = ["fp1", "fp2", "n"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A word is hashed eight bytes at a time, all words of a text together: each step mixes
    the next bytes into what came before, beginning with 64 mixed bits of the length, so
    that words which differ by bytes of zero alone differ too. Words of more than LONG
    bytes go by their BLAKE2 digest.
    """

    LONG = 64
    TOGETHER = 1 << 18
    SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
    #: the first k of eight bytes
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, width: int = 5):
        self.width = width

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words begin, runs without white space in ASCII, and their hashes."""
        space = self.SPACE[np.frombuffer(data, np.uint8)]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        edges = np.concatenate([[] if space[:1].all() else [0], turns, [] if space[-1:].all() else [len(data)]]).astype(np.int64)
        at, end = edges[::2], edges[1::2]
        eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
        left = end - at
        step = lambda h, at, left: mixed((h ^ (eight[at] & self.MASKS[np.minimum(left, 8)])) * MULTIPLIERS[1])
        h = step(mixed(left.astype(np.uint64) * MULTIPLIERS[2]), at, left)
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        if (long := left > self.LONG).any():
            for i in more[long].tolist():
                h[i] = int.from_bytes(hashlib.blake2b(data[edges[2 * i] : end[i]], digest_size=8).digest(), "little")
            more, at, left = more[~long], at[~long], left[~long]
        while len(more):
            h[more] = step(h[more], at, left)
            go = left > 8
            more, at, left = more[go], at[go] + 8, left[go] - 8
        return edges[::2], h

    @staticmethod
    def mix(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs of k words."""
        n = len(h) - k + 1
        out = np.full(max(n, 0), k, np.uint64)
        for i in range(k if n > 0 else 0):
            out += h[i : i + n] * (MULTIPLIERS[i % len(MULTIPLIERS)] + np.uint64(2 * (i // len(MULTIPLIERS))))
        return mixed(out)

    def sets(self, texts):
        """The set of each text, in order; short texts are hashed together."""
        group, size = [], 0
        for text in texts:
            group.append((text or "").encode().translate(LOWER))
            size += len(group[-1])
            if size >= self.TOGETHER:
                yield from self.group(group)
                group, size = [], 0
        yield from self.group(group)

    def group(self, texts: list[bytes]):
        starts, h = self.words(b"\n".join(texts))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
        whole = self.mix(h, self.width)
        for a, b in zip(bounds[:-1], bounds[1:]):
            out = np.sort(whole[a : b - self.width + 1] if b - a >= self.width else self.mix(h[a:b], b - a) if b > a else h[:0])
            yield out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.sets([text]))


def listed(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    """One list per array."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(kind) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _counts(width, bits):
    def run(batches):
        shingles, counts = Shingler(width), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for h in shingles.sets(batch.column(0).to_pylist()):
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        # each part in as few bytes as its largest count needs
        parts = [p.astype(np.min_scalar_type(p.max())).tobytes() for p in counts.reshape(SKETCH_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(parts, pa.binary())], ["part", "counts"])

    return run


def _added(bits):
    """Rows in order of part: the sums of each part's counts, as 1024ths of their log2."""
    cells = (1 << bits) // SKETCH_PARTS

    def run(batches):
        part, sums = None, None

        def row():
            levels = np.rint(1024 * np.log2(1.0 + sums)).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["part", "counts"])

        for batch in batches:
            for p, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    if sums is not None:
                        yield row()
                    part, sums = p, np.zeros(cells, np.int64)
                sums += np.frombuffer(counts, f"<u{len(counts) // cells}")
        if sums is not None:
            yield row()

    return run


def _sketch(texts: DataFrame, width: int) -> np.ndarray:
    """How often each cell of shingles occurs, on a logarithmic scale that never fills up.
    A cell for about every 100 bytes of text, 2**MOST_SKETCH cells (32 MB) at most."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, math.ceil(math.log2(size / 100))))
    found = texts.mapInArrow(lean(_counts(width, bits)), "part int, counts binary").repartition("part").sortWithinPartitions("part")
    parts = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint16)
    for row in found.mapInArrow(lean(_added(bits)), "part int, counts binary").toLocalIterator():
        parts[row["part"]] = np.frombuffer(row["counts"], "<u2")
    return parts.ravel()


def _prefixes(width, sketch):
    """Per text: its set's size and two sums that know it, its prefix, rarest first, and
    the distinct 16-bit codes of the prefix."""

    def run(batches):
        shingles, counts = Shingler(width), sketch.value
        shift = np.uint64(65 - len(counts).bit_length())
        for batch in batches:
            ns, one, two, heads, codes = [], [], [], [], []
            for h in shingles.sets(batch.column(1).to_pylist()):
                n = len(h)
                order = np.argsort(counts[(h >> shift).astype(np.int64)], kind="stable")
                ns.append(n)
                one.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mixed(h * MULTIPLIERS[0]).sum(dtype=np.uint64).view(np.int64)))
                heads.append(h[order[: prefix_size(n)]] if n else h)
                codes.append(np.unique(heads[-1].astype(np.uint16)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), listed(heads), listed(codes, np.int16)],
                ["doc_id", "n", "fp1", "fp2", "prefix", "codes"],
            )

    return run


def prefix_size(n):
    """Sets of n shingles that link share one among their first so many."""
    return n - -(-3 * n // 4) + 1


def _sets(width):
    def run(batches):
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), listed([*shingles.sets(part.column(1).to_pylist())])], ["doc", "shingles"])

    return run


def _pivots(batches):
    """Rows in order of s, then of preference: each row of a block of two or more, with
    the block's first row (document, size, room) as its pivot. Holds one row at a time
    beyond a batch."""
    held, last, pivot = None, None, None
    names = ["doc", "n", "room"]
    for batch in batches:
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None])
        s = table.column("s").to_numpy()
        if not len(s):
            continue
        own = [table.column(c).to_numpy() for c in names]
        first = np.concatenate([[last is None or s[0] != last], s[1:] != s[:-1]])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
        inside = lead >= 0
        pivots = [np.where(inside, c[lead], p) for c, p in zip(own, pivot or (0, 0, 0))]
        keep = ~first
        keep[:-1] |= ~first[1:]
        keep[-1] = not first[-1]
        held = table.slice(len(s) - 1).combine_chunks().to_batches()[0] if first[-1] else None
        if held is None:
            last, pivot = s[-1], [p[-1] for p in pivots]
        elif len(s) > 1:
            last, pivot = s[-2], [p[-2] for p in pivots]
        for name, p, kind in zip(names, pivots, (pa.int64(), pa.int32(), pa.int32())):
            table = table.append_column(f"pivot_{name}", pa.array(p, kind))
        yield from table.filter(pa.array(keep)).to_batches()


def _cell_pairs(batches):
    """Rows in order of their cell: the pairs of each cell that may link."""
    held, block = [], None

    def pairs(tables):
        t = pa.concat_tables(tables)
        side, main, doc, n, room, comp = (t.column(c).to_numpy() for c in ("side", "main", "doc", "n", "room", "comp"))
        d = t.column("d").to_numpy(zero_copy_only=False).astype(float)  # null: not known
        diagonal = t.column("i")[0].as_py() == t.column("j")[0].as_py() and not main.any()
        left = np.flatnonzero(side == 0)
        right = left if diagonal else np.flatnonzero(side == 1)
        for at in range(0, len(left), CELL):
            x, y = left[at : at + CELL, None], right[None, :]
            may = (doc[x] < doc[y]) if diagonal else (doc[x] != doc[y])
            may &= comp[x] != comp[y]
            may &= 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
            may &= 7 * np.minimum(room[x], room[y]) >= 3 * (n[x] + n[y])
            may &= ~(np.abs(d[x] - d[y]) > RADIUS + 1e-9)
            i, j = np.nonzero(may)
            a, b = doc[x[i, 0]], doc[y[0, j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("s", "main", "i", "j")])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(key[:, a])
            if held and now != block:
                yield from pairs(held)
                held = []
            block = now
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield from pairs(held)


ROW = "s long, doc long, n int, room int, met long"


def _with_pivots(rows: DataFrame, *order) -> DataFrame:
    """Rows as ROW has them: those of blocks of two or more, with their pivots."""
    rows = rows.select("s", "doc", "n", "room", "met", *(c.alias(f"o{i}") for i, c in enumerate(order)))
    by = [f"o{i}" for i in range(len(order))]
    rows = rows.repartition("s").sortWithinPartitions("s", *by, F.desc("met"), "n", "doc").select("s", "doc", "n", "room", "met")
    return rows.mapInArrow(lean(_pivots), ROW + ", pivot_doc long, pivot_n int, pivot_room int")


def _met(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``met``: how many others a document meets over all of its blocks."""
    sizes = blocks.groupBy("s").agg((F.count("*") - 1).alias("others"))
    met = blocks.join(sizes, "s").groupBy("doc").agg(F.sum("others").alias("met"))
    return blocks.drop("met").join(met, "doc")


def _cells_of_pivots(blocks: DataFrame) -> DataFrame:
    """(a, b): for each document b the pivot a that it shares most blocks with, of those
    that sizes and places in their orders let it link with (ties: the smaller)."""
    fits = F.expr("doc <> pivot_doc and 4 * least(n, pivot_n) >= 3 * greatest(n, pivot_n) and 7 * least(room, pivot_room) >= 3 * (n + pivot_n)")
    shared = blocks.where(fits).groupBy("pivot_doc", "doc").count()
    best = shared.groupBy("doc").agg(F.max_by("pivot_doc", F.struct("count", -F.col("pivot_doc"))).alias("a"))
    return best.select("a", F.col("doc").alias("b"))


def _screened(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (a, b) of distinct documents: (a, b, low, maybe), from their prefixes alone.
    Common shingles after the prefix that ends first number at most what is left of that
    set, and codes that two shingles of a prefix share hide at most as many as there are,
    so low bounds the distance from below, and maybe says if they could link."""
    left, right = points.toDF("a", "na", "ca"), points.toDF("b", "nb", "cb")
    size = lambda n: F.expr(f"{n} - ceil(3 * {n} / 4) + 1")
    hidden = F.least(size("na") - F.size("ca"), size("nb") - F.size("cb"))
    most = F.size(F.array_intersect("ca", "cb")) + hidden + F.greatest(F.col("na") - size("na"), F.col("nb") - size("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.least(most, "na", "nb").alias("most"))
    return both.select("a", "b", (1 - F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))).alias("low"), (7 * F.col("most") >= 3 * (F.col("na") + F.col("nb"))).alias("maybe"))


def _measured(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) of distinct documents: (a, b, d, linked), exactly. Only texts of the
    pairs' documents are cut into shingles."""
    docs = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    bits = bits_for(2 * pairs.count())
    ids = bloom_words(docs, F.col("doc"), bits)
    sets = rows.where(bloom_hit(ids, F.col("doc_id"), bits)).mapInArrow(lean(_sets(width)), "doc long, shingles array<long>")
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("common"), union.alias("union"))
        .select("a", "b", (1 - F.col("common") / F.col("union")).alias("d"), (100 * F.col("common") >= 75 * F.col("union")).alias("linked"))
    )


def _cells(rest: DataFrame) -> DataFrame:
    """rest (s, doc, n, room, comp, d): rows dealt to cells, so that any two rows of a
    block that are not both of its largest component meet in one cell."""
    share = rest.groupBy("s", "comp").count()
    most = share.groupBy("s").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("rows"))
    most = most.select("s", F.col("top.comp").alias("main_comp"), F.col("top.count").alias("n_main"), (F.col("rows") - F.col("top.count")).alias("n_other"))
    rows = rest.join(most.where("n_other > 0"), "s").withColumn("in_main", F.col("comp") == F.col("main_comp"))
    k_main = F.ceil(F.col("n_main") / CELL).cast("int")
    k_other = F.ceil(F.col("n_other") / CELL).cast("int")
    h = F.xxhash64("doc")
    g = F.when(F.col("in_main"), F.pmod(h, k_main)).otherwise(F.pmod(h, k_other)).cast("int")
    keep = ["s", "doc", "n", "room", "comp", "d"]
    rows = rows.withColumn("g", g).withColumn("k_main", k_main).withColumn("k_other", k_other)
    # cells (main, i, j): a slice of the largest component against a slice of the others
    a = rows.where("in_main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k_other") - 1)))
    a = a.select(*keep, F.lit(1).alias("main"), F.col("g").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
    b = rows.where("not in_main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k_main") - 1)))
    b = b.select(*keep, F.lit(1).alias("main"), F.col("other").alias("i"), F.col("g").alias("j"), F.lit(1).alias("side"))
    # cells (0, i, j), i <= j: slices of the others against each other
    c = rows.where("not in_main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k_other") - 1)))
    c = c.select(
        *keep, F.lit(0).alias("main"), F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"), F.when(F.col("g") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    return a.union(b).union(c)


def jaccard_components(docs: DataFrame, width: int = 5, levels: int = 4, few: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id
    reachable by links of Jaccard similarity 0.75 or more between sets of word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    ``width`` is one shingle. Null texts and texts without words have an empty set, link
    with nothing and are their own component. Rows with a null doc_id keep their set size
    and have a null component. Rows that repeat a doc_id each give a row; a doc_id that
    stands for different texts links wherever one of them does. Words and texts of any
    length count whole; a text's set is held in one task's memory. An empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    cut = scratch.cut
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = spark.sparkContext.broadcast(_sketch(rows.select("text"), width))
    schema = "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, codes array<short>"
    heads = cut(rows.mapInArrow(lean(_prefixes(width, sketch)), schema), "prefixes")
    sketch.destroy()

    # equal sets are one point
    named = heads.where("n > 0 and doc_id is not null")
    same = cut(named.groupBy(*SAME).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"), "equal-sets")
    bits = bits_for(same.count())
    maybe = bloom_hit(bloom_words(same, F.struct(*SAME), bits), F.struct(*SAME), bits)

    def points(*columns):
        once = named.select("doc_id", *SAME, *columns)
        copies = once.where(maybe).join(same, SAME, "left").where("rep is null or rep = doc_id").dropDuplicates(["doc_id", *SAME])
        return once.where(~maybe).union(copies.select(once.columns)).select("doc_id", "n", *columns)

    index = points("prefix").select("doc_id", "n", F.posexplode("prefix")).select(
        F.col("col").alias("s"), F.col("doc_id").alias("doc"), F.col("n").cast("int"), (F.col("n") - F.col("pos")).cast("int").alias("room")
    )
    shared = cut(_with_pivots(index.withColumn("met", F.lit(0).cast("long"))).select("s", "doc", "n", "room"), "shared")
    blocks = cut(_with_pivots(_met(shared)), "blocks")
    scratch.drop(shared)
    codes = cut(points("codes").join(blocks.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "codes")

    # a doc_id of different texts ties the points that stand for them
    sets = F.struct(*SAME)
    many = named.groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").select("doc_id")
    ties = cut(named.select("doc_id", *SAME).join(many, "doc_id", "left_semi").join(same, SAME).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ties")

    comps, before = ties, None
    for level in range(levels):
        known = cut(_screened(_cells_of_pivots(blocks), codes), "bounds")
        exact = cut(_measured(known.where("maybe").select("a", "b"), rows, width), "distances")
        comps = _joined(comps, exact, scratch)
        label = comps.toDF("doc", "component")
        labelled = cut(blocks.join(label, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component"), "labelled")
        mixed_blocks = labelled.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("s")
        live = cut(labelled.join(mixed_blocks, "s"), "live")
        scratch.drop(blocks, labelled)
        to_pivot = known.join(exact, ["a", "b"], "left").select(F.col("a").alias("pivot_doc"), F.col("b").alias("doc"), "low", "d")
        placed = live.join(label.toDF("pivot_doc", "region"), "pivot_doc", "left").join(to_pivot, ["pivot_doc", "doc"], "left")
        placed = placed.withColumn("linked", F.col("comp") == F.coalesce("region", "pivot_doc"))
        placed = placed.withColumn("d", F.when(F.col("doc") == F.col("pivot_doc"), 0.0).otherwise(F.col("d")))
        far = F.coalesce("d", "low", F.expr("1 - least(n, pivot_n) / greatest(n, pivot_n)"))
        placed = cut(placed.select("s", "doc", "n", "room", "met", "d", "linked", "comp", far.alias("far")), "placed")
        edge = placed.where("not linked").groupBy("s").agg(F.min("far").alias("nearest"))
        outside = placed.join(edge, "s").where(f"not linked or d is null or d >= nearest - {RADIUS} - 1e-9")
        outside = cut(outside.select("s", "doc", "n", "room", "met", "d", "linked", "comp"), "outside")
        shape = outside.groupBy("s").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("c > 1 and low <> high")
        rest = cut(outside.join(shape.select("s", "c"), "s"), "rest")
        scratch.drop(known, exact, live, placed, outside)
        left, work = rest.agg(F.count("*"), F.sum(F.col("c").cast("double"))).first()
        if not left or level == levels - 1 or work <= few * left or (before is not None and left > 0.5 * before):
            break
        before = left
        blocks = cut(_with_pivots(rest, F.col("linked").cast("int")), "blocks")
        fewer = cut(codes.join(rest.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "codes")
        scratch.drop(rest, codes)
        codes = fewer

    if left:
        cells = _cells(rest).repartition("s", "main", "i", "j").sortWithinPartitions("s", "main", "i", "j")
        pairs = cells.mapInArrow(lean(_cell_pairs), "a long, b long").distinct()
        maybe_linked = cut(_screened(pairs, codes).where("maybe").select("a", "b"), "bounds")
        comps = _joined(comps, cut(_measured(maybe_linked, rows, width), "links"), scratch)
    scratch.drop(rest, codes)
    narrow = cut(heads.select("doc_id", *SAME), "sizes")
    scratch.drop(heads)
    found = narrow.join(same, SAME, "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    found = found.join(comps.toDF("rep", "component_id"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))


def _joined(comps: DataFrame, exact: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after the links of ``exact`` (a, b, linked) joined them."""
    after = components(exact.where("linked").select("a", "b").union(comps), scratch)
    scratch.drop(comps)
    return after
