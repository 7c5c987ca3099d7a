"""The neighbour graph and search go on until nothing is left to do."""

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import ann
from siftline.llm.common import ship


def packed(spark, x):
    ship(spark)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "v long, embedding array<double>")
    return rows.repartition(2).mapInArrow(ann._unit, "v long, x binary, c binary")


def test_rounds_run_until_settled(spark):
    x = np.random.default_rng(7).standard_normal((1500, 24))
    graph = ann.neighbour_graph(packed(spark, x).persist(), len(x), k=16, leaf=32, trees=2)
    got = {}
    for r in graph.collect():
        got.setdefault(r.v, set()).add(r.w)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :16]
    assert np.mean([len(got[i] & set(want[i].tolist())) / 16 for i in range(len(x))]) > 0.9


def test_search_expands_its_whole_beam(spark):
    angle = np.arange(64) * 0.02
    nodes = packed(spark, np.stack([np.cos(angle), np.sin(angle)], axis=1)).persist()
    graph = spark.range(63).select(F.col("id").alias("v"), (F.col("id") + 1).alias("w"), F.lit(0.5).alias("s"))
    found = ann.search(graph, nodes.select("v", "x"), nodes.where("v = 0").select("v"), beam=16, expand=2)
    assert {r.w for r in found.collect()} >= set(range(16))
