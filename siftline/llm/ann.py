"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Blocks only seed the graph: vectors in order of the
random directions that they are nearest to, cut into runs of LEAF, each compared in full,
for a few sets of directions. Each NN-descent round is a Spark join of neighbours of neighbours: the two
neighbourhoods (out and in) of every node meet in one group, members that have not met
there are compared, and each node keeps its best K. Rounds go on, whatever the size, until
one changes less than SETTLED of all edges. In-neighbourhoods of any size are dealt to
several groups, anew each round, so none is cut off. Queries start from their own node and
repeatedly expand the best nodes that they have not expanded, by joins with the graph,
until the whole beam is expanded. The nearest found are scored again in double precision
on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, ship

K = 32
LEAF = 128
TREES = 4
SETTLED = 0.005
GROUP = 128
DIRECTIONS = 64
BEAM = 128
EXPAND = 32
EDGE = "v long, w long, s float"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: of the commonest size,
    not zero, without null or non-finite components."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0)
    fine &= ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (sizes["n"] if sizes else 0))


def _unit(batches):
    """Unit vectors as bytes: in half precision, and coarser in 8 bits for the graph."""
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
        coarse = np.rint(127 * x).astype(np.int8)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in coarse], pa.binary())], ["v", "x", "c"]
        )


def matrix(column, kind=np.float16) -> np.ndarray:
    rows = column.to_pylist()
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(seed: int, digits: int, directions: int):
    """The numbers of the nearest of some random directions, a set for each digit, and
    the second nearest of the last set."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), np.int8)
            random = np.random.default_rng(seed)
            code = np.zeros(len(x), np.int64)
            for digit in range(digits):
                p = np.argsort(-(x @ random.standard_normal((x.shape[1], directions))), axis=1)
                code = code * directions + p[:, 0]
                if digit == digits - 1:
                    code = code * directions + p[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], ["v", "c", "code"])

    return run


def best(ids: np.ndarray, x: np.ndarray, k: int, new: np.ndarray | None = None):
    """Rows (v, w, s): for each of ids its k nearest among the others; pairs of which
    neither is new have s = -2."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    if new is not None:
        old = np.flatnonzero(~new)
        s[np.ix_(old, old)] = -2
    k = min(k, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, axis=1).ravel()


def edges(parts) -> pa.RecordBatch:
    v, w, s = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(s.astype(np.float32))], ["v", "w", "s"])


def _blocks(k: int, leaf: int):
    def run(batches):
        ids, rows = np.zeros(0, np.int64), []
        for batch in batches:
            ids, rows = np.concatenate([ids, batch.column(0).to_numpy()]), rows + batch.column(1).to_pylist()
            while len(ids) >= 2 * leaf:
                yield edges([best(ids[:leaf], matrix(pa.array(rows[:leaf]), np.int8), k)])
                ids, rows = ids[leaf:], rows[leaf:]
        if len(ids) > 1:
            yield edges([best(ids, matrix(pa.array(rows), np.int8), k)])

    return run


def _meet(k: int):
    """Rows (hub, part, w, new, worst, c) in order of hub and part: members of a group are
    compared, one of them new, and pairs better than a member's worst neighbour come out."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
            if not table.num_rows:
                continue
            hub, part = table.column("hub").to_numpy(), table.column("part").to_numpy()
            edge = np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1
            starts = [0, *edge.tolist()]
            done = starts[-1]
            held = table.slice(done).to_batches()[0] if done < len(hub) else None
            if done:
                yield from compare(table.slice(0, done), starts, k)
        if held is not None and held.num_rows > 1:
            yield from compare(pa.Table.from_batches([held]), [0, held.num_rows], k)

    def compare(table, starts, k):
        ids, x, worst = table.column("w").to_numpy(), matrix(table.column("c"), np.int8), table.column("worst").to_numpy()
        new, parts = table.column("new").to_numpy(), []
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1 and new[a:b].any():
                v, w, s = best(ids[a:b], x[a:b], k, new[a:b])
                better = s > np.repeat(worst[a:b], len(v) // (b - a))
                parts.append((v[better], w[better], s[better]))
        if parts:
            v, w, s = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((w, v))
            v, w, s = v[order], w[order], s[order]
            fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])[: len(v)]
            yield edges([(v[fresh], w[fresh], s[fresh])])

    return run


def kept(rows: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node, new if no row of the edge is old; one shuffle."""
    rows = rows.repartition("v").groupBy("v", "w").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    order = Window.partitionBy("v").orderBy(F.desc("s"), "w")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def neighbour_graph(nodes: DataFrame, n: int, k: int = K, leaf: int = LEAF, trees: int = TREES, settled: float = SETTLED) -> DataFrame:
    """(v, w, s): for each node (v, c) its k nearest found."""
    nodes = nodes.select("v", "c")
    parts = max(1, math.ceil(n / 4096))
    cells = max(2, n // leaf)
    digits = max(1, math.ceil(math.log(cells) / math.log(DIRECTIONS) - 1e-9))
    new = F.lit(True).alias("new")
    first = None
    for tree in range(trees if n > leaf else 1):
        coded = nodes.mapInArrow(_codes(tree, digits, min(DIRECTIONS, cells)), "v long, c binary, code long")
        found = coded.repartitionByRange(parts, "code", "v").sortWithinPartitions("code", "v").select("v", "c").mapInArrow(_blocks(k, leaf), EDGE)
        first = found if first is None else first.union(found)
    graph = cut(kept(first.select("*", new), k), "graph")
    changed, turn = n > 1, 0
    while changed:
        both = graph.select(F.col("v").alias("hub"), "w", "new").union(graph.select(F.col("w").alias("hub"), F.col("v").alias("w"), "new"))
        both = both.union(nodes.select(F.col("v").alias("hub"), F.col("v").alias("w"), F.lit(False))).groupBy("hub", "w").agg(F.min("new").alias("new"))
        degree = graph.groupBy(F.col("w").alias("hub")).agg(F.ceil((F.count("*") + k + 1) / GROUP).cast("int").alias("parts"))
        both = both.join(degree, "hub", "left").withColumn("part", F.pmod(F.xxhash64("w", F.lit(turn)), F.coalesce("parts", F.lit(1))).cast("int"))
        # members that are dealt anew can meet others for the first time
        both = both.withColumn("new", F.col("new") | (F.coalesce("parts", F.lit(1)) > 1))
        worst = graph.groupBy(F.col("v").alias("w")).agg(F.when(F.count("*") >= k, F.min("s")).alias("worst"))
        rated = nodes.withColumnRenamed("v", "w").join(worst, "w", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.5).cast("float")))
        members = both.select("hub", "part", "w", "new").join(rated, "w").select("hub", "part", "w", "new", "worst", "c")
        # k of a group are enough: what they crowd out is worse than a node's new k best
        met = members.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_meet(k), EDGE)
        old = graph.select("v", "w", "s", F.lit(False).alias("new"))
        graph = cut(kept(old.union(met.select("*", new)), k), "graph")
        changed = graph.where("new").count() > settled * graph.count()
        turn += 1
    return graph.drop("new")


def _rated(batches):
    for batch in batches:
        if batch.num_rows:
            s = (matrix(batch.column(2)) * matrix(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["q", "w", "s"])


def _exact(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array(batch.column(i).to_pylist(), np.float64) for i in (2, 3))
            s = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["query_id", "vec_id", "score"])


def search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(q, w, s) visited by a greedy search from each start node q, q itself included,
    until the best ``beam`` of each are all expanded."""
    links = cut(graph.select("v", "w").union(graph.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "links")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "w")
    state = starts.select(F.col("v").alias("q"), F.col("v").alias("w"), F.lit(1.0).cast("float").alias("s"), F.lit(False).alias("expanded"))
    qx = starts.join(nodes, "v").toDF("q", "qx")
    while True:
        # the best beam, of which the first few that were not expanded yet are
        near = state.withColumn("r", F.row_number().over(order))
        near = near.withColumn("nth", F.sum(F.when(~F.col("expanded") & (F.col("r") <= beam), 1).otherwise(0)).over(order))
        go = ~F.col("expanded") & (F.col("r") <= beam) & (F.col("nth") <= expand)
        near = cut(near.select("q", "w", "s", "expanded", go.alias("go")), "beam")
        if near.where("go").isEmpty():
            return near.select("q", "w", "s")
        reached = near.where("go").select("q", F.col("w").alias("v")).join(links, "v").select("q", "w").distinct()
        fresh = reached.join(near.select("q", "w"), ["q", "w"], "left_anti")
        rated = fresh.join(nodes.toDF("w", "x"), "w").join(qx, "q").select("q", "w", "x", "qx").mapInArrow(_rated, "q long, w long, s float")
        state = near.select("q", "w", "s", (F.col("expanded") | F.col("go")).alias("expanded")).union(rated.withColumn("expanded", F.lit(False)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, graph_k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``
    its k nearest rows found, by cosine in double precision, ties to the smaller vec_id.

    Vectors that are null, zero, of another size than the commonest, or hold null or
    non-finite components take no part, and neither do rows with a null vec_id. Rows that
    repeat a vec_id with another vector count as rows of their own; a query never gets its
    own vec_id. Fewer candidates than k give all of them, and an empty table no rows.
    Columns other than vec_id and embedding are not read.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors.where("vec_id is not null"))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("rep", F.first("vec_id").over(order))
    # k + 1 members of a class of equal vectors are enough: all have the same score
    members = cut(ranked.where(F.col("r") <= k + 1), "members")
    own = members.where("r = 1").select(F.col("rep").alias("v"), "embedding")
    nodes = cut(own.mapInArrow(_unit, "v long, x binary, c binary"), "nodes")
    graph = neighbour_graph(nodes, nodes.count(), graph_k)
    nodes = nodes.select("v", "x")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(own, "embedding")
    queries = cut(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("embedding").alias("qe")).distinct(), "queries")
    found = search(graph, nodes, queries.select(F.col("q").alias("v")).distinct())
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "w"))).where(F.col("r") <= 4 * k)
    pairs = queries.join(cut(top.select("q", "w"), "found"), "q").join(members.select(F.col("rep").alias("w"), "vec_id", "embedding"), "w")
    pairs = pairs.where("vec_id <> query_id").select("query_id", "vec_id", "qe", "embedding")
    scored = pairs.mapInArrow(_exact, "query_id long, vec_id long, score double")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = scored.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
