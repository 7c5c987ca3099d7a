"""Pipeline stages and the Jaccard join on nulls, empty, long and repeated rows, and columns
whose names clash with the operators' own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, base string, found string, score string, predicted string, _sha string, _row string, _id string"


@pytest.fixture(scope="module")
def words():
    random = np.random.default_rng(7)
    return lambda n: " ".join(f"w{x}" for x in random.integers(0, 5000, n))


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefgh") for i, t in rows], SCHEMA)


def test_edges_through_all_stages(spark, labels, words):
    a, b, long = words(60), words(60), words(30_000)
    secret = words(10) + " password = hunter2hunter2 " + words(5)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, a), (3, a), (4, None), (5, ""), (6, " \n "), (7, long), (8, long + " end"), (9, secret), (None, b), (None, None)]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.cut(stage(spark, docs, labels), "edges")
        assert docs.schema.simpleString() == table(spark, []).schema.simpleString(), name
        assert all(tuple(r)[5:] == tuple("abcdefgh") for r in docs.collect()), name
    left = {(r.doc_id, r.text) for r in docs.collect()}
    # exact: of a and its copies (3, a) stays; of b (1, b); of the empty ones (5, "")
    # near: (2, a tail) goes or (3, a): the smallest of the group, 2, stays; 8 goes for 7
    masked = [t for i, t in left if i == 9]
    assert len(masked) == 1 and "[SECRET]" in masked[0] and "hunter2" not in masked[0]
    assert {x for x in left if x[0] != 9} == {(1, b), (2, a + " tail"), (5, ""), (6, " \n "), (7, long)}
    assert docs.where("doc_id = 9").first().n_chars == len(masked[0])
    assert docs.count() == 6


def test_repeated_ids_link_by_their_own_texts(spark, labels, words):
    a, b = words(60), words(60)
    rows = [(1, a), (5, a + " tail"), (5, b), (9, b + " tail"), (None, a)]
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, table(spark, rows), labels).collect()}
    assert left == {(1, a), (5, b), (None, a)}


def test_stages_of_an_empty_table(spark, labels):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, labels)
        assert out.count() == 0, name


def thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_are_told_apart(spark):
    shingles = jaccard_join.Shingler()
    for k in (3, 5, 6, 10, 12):
        one, other = thue_morse(k)
        assert shingles(one) != shingles(other)
    lengths = [int(shingles("x" * n)[0]) for n in range(1, 300)]
    assert len(set(lengths)) == len(lengths)
    one, other = thue_morse(10)
    docs = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_texts_hashed_together_are_as_alone(words):
    shingles = jaccard_join.Shingler()
    texts = ["", None, " ", "one", "one two three four", words(5), words(400), "\t", words(7), "y" * 500 + " z", ""]
    together = list(shingles.sets(texts))
    assert len(together) == len(texts)
    for t, s in zip(texts, together):
        assert (s == shingles(t)).all() and len(s) == len(shingles(t))
    assert len(shingles("one two three four")) == 1 and len(shingles(" ")) == 0


def test_components_of_an_empty_table_and_repeated_ids(spark, words):
    a, b = words(80), words(80)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(4, a), (4, b), (2, a), (3, b + " end"), (7, b), (None, a), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x")).withColumn("n", F.lit(0))
    got = sorted(((r.doc_id or 0), r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    # 4 stands for both texts, so everything hangs together through it
    assert got == [(0, None), (2, 2), (3, 2), (4, 2), (4, 2), (7, 2), (8, 8), (9, 9)]


def test_many_near_copies_with_few_pairs(spark):
    random = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(120):
        now = list(base)
        for at in random.choice(200, 4, replace=False):
            now[at] = f"x{d}_{at}"
        rows.append((d, " ".join(now)))
    rows += [(1000 + d, " ".join(f"u{d}_{i}" for i in range(150))) for d in range(30)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                i, j = find(x), find(y)
                parent[max(i, j)] = min(i, j)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (0, 10**9):
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, few=few).collect()}
        assert got == {d: find(d) for d in sets}
