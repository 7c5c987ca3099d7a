"""Secret scans of one long token, of many matches in one text, and at the tables' edges."""

import time

from pyspark.sql import functions as F

from siftline.llm import secret_scan

DOCS = "doc_id long, text string, base string, found string"


def base(spark):
    return [(i, f"an ordinary_identifier and password=9f8e7d6c5b4a{i:06d}x here {i:040x}", "clash", "clash") for i in range(60)]


def test_long_token_and_many_matches(spark):
    token = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1_000_000))
    many = "x ".join(f"password=secret{i:05d}\U0001f600" for i in range(100_000))
    rows = base(spark) + [(1000, token, "", ""), (1001, many, "", "")]
    secret_scan.scan_secrets(spark.createDataFrame(rows[:60], DOCS)).collect()  # compiled
    began = time.time()
    docs = secret_scan.with_spans(spark.createDataFrame(rows, DOCS), base="b_", found="f_")
    docs = docs.withColumn("masked", secret_scan.redact(F.col("text"), F.col("f_")))
    found = {r.doc_id: r for r in docs.where("doc_id >= 1000").select("doc_id", F.size("b_").alias("n"), "masked").collect()}
    assert found[1001].n == 100_000
    assert found[1001].masked == "x ".join("[SECRET]\U0001f600" for _ in range(100_000))
    assert found[1000].n == 0
    assert time.time() - began < 90  # minutes per row before, and growing with the square


def test_blocks_give_what_one_pass_gives(spark):
    import re

    text = "".join(f"é{'f' * (24 + i % 5)} \U0001f600 api_key: '{i}abcdef' {'AKIA' + 'Z' * (10 + i % 20)}! " for i in range(700))
    row = secret_scan.with_spans(spark.createDataFrame([(1, text, "", "")] + base(spark), DOCS), base="b", found="f").where("doc_id = 1 and text like 'é%'").first()
    want = []
    for n, (kind, (pattern, least)) in enumerate(secret_scan.KINDS.items()):
        for m in re.finditer(pattern, text):
            if len(m[2]) >= least:
                want.append((m.start(), n, m.end(), kind))
    assert [(s.start, s.kind_no, s.end, s.kind) for s in row.b] == sorted(want)


def test_letters_alone_can_be_random(spark):
    import random

    r = random.Random(5)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    word = lambda: "".join(r.choice(["ment", "tion", "able", "con", "pre", "ing"]) for _ in range(6))
    samples = [(key(32), True) for _ in range(300)] + [(word(), False) for _ in range(300)]
    model = secret_scan.Markov(spark.createDataFrame(samples, "token string, random boolean"))
    texts = spark.createDataFrame([(500, f"see {key(40)} there"), (501, f"see {word()}{word()} there"), (502, f"password={key(30)}")], "doc_id long, text string")
    found = texts.select("doc_id", secret_scan.shown(model.spans(F.col("text"), secret_scan.base_spans(F.col("text")))).alias("spans"))
    assert {x.doc_id: x.spans for x in found.collect()} == {500: "markov:4:44", 501: "", 502: ""}


def test_edges_of_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert secret_scan.scan_secrets(empty).collect() == []
    rows = [(None, None, "", ""), (1, "", "", ""), (1, "password=abcdef1", "", ""), (1, "password=abcdef1", "", "")]
    got = sorted((r.doc_id or 0, r.n_assign, r.spans) for r in secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (1, 1, "assign:0:16"), (1, 1, "assign:0:16")]
