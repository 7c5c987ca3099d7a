"""Helpers that the training-data operators share: durable cuts of a lineage,
Bloom filters as plain columns, and connected components by Spark joins."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: bytes of an Arrow batch; one text may be larger
BATCH = "4m"
#: a Bloom filter's largest size; beyond it more rows pass, which costs time and no result
MOST_BITS = 26


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and keep
    Arrow batches of whole texts small unless the session says otherwise."""
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{have}".rstrip(":")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":  # Spark's default
        spark.conf.set(size, BATCH)


#: what the operator that ran last in this Python worker keeps between its tasks
_kept: dict = {}


def kept(owner: tuple) -> dict:
    """A worker's cache for ``owner``. Workers are used again by later stages: what another
    operator left there goes first, and its memory back to the system."""
    if owner not in _kept:
        _kept.clear()
        release()
    return _kept.setdefault(owner, {})


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, owner: tuple = ("nothing",)):
    """``run``, for mapInArrow, in a worker that keeps only what ``owner`` cached; a task's
    memory goes back to the system when it ends."""

    def lean_run(batches):
        kept(owner)
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where
    neither the setting nor the context names one (single-machine tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends
    here, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Scratch:
    """The cuts of one run in a folder of their own. drop() deletes cuts that nothing reads
    any more: no frame that is still to be computed may come from them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        self.n = 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Also has the driver collect its garbage: Spark deletes a shuffle's files once
        nothing on the driver refers to it."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        for out, path in self.paths:
            if any(out is f for f in frames):
                where = fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = [(out, path) for out, path in self.paths if not any(out is f for f in frames)]
        gc.collect()
        self.spark._jvm.System.gc()


# ---------------------------------------------------------------- Bloom filters


def bloom_bits(key: Column, log2_bits: int, hashes: int, seed: int = 0) -> list[Column]:
    """The positions of ``key`` (any type) in a filter of 2**log2_bits bits."""
    return [
        F.shiftrightunsigned(F.xxhash64(F.lit(seed * 64 + i), key), 64 - log2_bits)
        for i in range(hashes)
    ]


def bits_for(n: int, least: int = 10) -> int:
    """The size of a filter of n keys: about 16 bits a key, up to MOST_BITS."""
    return min(MOST_BITS, max(least, math.ceil(math.log2(16 * max(n, 1)))))


def bloom_words(df: DataFrame, key: Column, log2_bits: int, hashes: int = 3, seed: int = 0) -> np.ndarray:
    """The filter's 64-bit words. Spark ors the bits of each word before anything moves;
    the driver gets at most 2**(log2_bits - 6) rows, whatever the size of ``df``."""
    bits = df.select(F.explode(F.array(*bloom_bits(key, log2_bits, hashes, seed))).alias("bit"))
    found = (
        bits.groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(bit & 63 as int)"))).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (log2_bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def bloom_hit(words: np.ndarray, key: Column, log2_bits: int, hashes: int = 3, seed: int = 0) -> Column:
    """Whether the filter may hold ``key``: bit tests on an array, no Python. A small
    array is a literal; a large one is read by a scalar subquery, once for each executor,
    so that plans and event logs stay small."""
    if len(words) <= 64:
        array = F.array(*map(F.lit, words.tolist())).cast("array<long>")
    else:
        spark = SparkSession.active()
        row = pa.table({"words": pa.array([words], pa.list_(pa.int64()))})
        array = cut(spark.createDataFrame(row), "bloom").scalar()
    hit = F.lit(True)
    for bit in bloom_bits(key, log2_bits, hashes, seed):
        word = F.get(array, F.shiftright(bit, 6).cast("int"))
        shift = F.call_function("pmod", bit, F.lit(64)).cast("int")
        hit = hit & (F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1)) == 1)
    return hit


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``removed`` (columns doc_id and, where given,
    text_sha256). Rows that a filter of the removed ids lets through never move; the few
    others are settled by an anti join. A null doc_id is a key like any other."""
    log2_bits = bits_for(removed.count())
    words = bloom_words(removed, F.col("doc_id"), log2_bits)
    maybe = bloom_hit(words, F.col("doc_id"), log2_bits)
    own = {c: fresh_name(docs, f"_removed_{c}") for c in removed.columns}
    out = removed.select([F.col(c).alias(n) for c, n in own.items()]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own["doc_id"]))
    if "text_sha256" in own:
        same &= F.sha2(F.coalesce("text", F.lit("")), 256) == F.col(own["text_sha256"])
    return docs.where(~maybe).unionByName(docs.where(maybe).join(out, same, "left_anti"))


# ---------------------------------------------------------------- components


def _contract(most: int = 1 << 20):
    """Edges (u, v) to stars (u, least id of u's component among the edges of this task so
    far). At most ``most`` edges are held."""

    def stars(u, v):
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root[a] == root[b]).all():
                break
        far = np.flatnonzero(root != np.arange(len(ids)))
        return ids[far], ids[root[far]]

    def run(batches):
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u = np.concatenate([u, batch.column(0).to_numpy()])
            v = np.concatenate([v, batch.column(1).to_numpy()])
            if len(u) >= most:
                u, v = stars(u, v)
                if len(u) >= most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.zeros(0, np.int64)
        if len(u):
            u, v = stars(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), where
    component is the smallest id of the component. Tasks contract the edges that they hold
    to stars; while a node stands in two stars, all edges go through two star contractions
    and are contracted again. Every round is written, nothing is collected."""
    ship(edges.sparkSession)
    near = lambda df: df.mapInArrow(lean(_contract()), "u long, v long")
    now = scratch.cut(near(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), "stars")
    while True:
        # done when each node is either a root or in one star
        roles = now.select(F.col("u").alias("id"), F.lit(1).alias("n")).union(now.select("v", F.lit(0)).distinct())
        if roles.groupBy("id").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).where("n > 1 or (n = 1 and rows > 1)").isEmpty():
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, now = now, scratch.cut(near(small.distinct()), "stars")
        scratch.drop(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
