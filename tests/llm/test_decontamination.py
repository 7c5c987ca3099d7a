"""Benchmark decontamination against a search of every window in every text."""

import hashlib
import random
import re

import numpy as np

from siftline.llm import decontaminate as D

SCHEMA = "doc_id long, text string, n_words string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, itext in items:
            v = words(itext)
            n = min(10, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit)))
    return out


def case(seed=3):
    r = random.Random(seed)
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(["ab", "Zé", "x9", "ab b", "Q", "łł"]) for _ in range(n))
    items = [(1, say(14)), (2, say(11)), (2, say(10)), (None, say(12)), (3, "one two"), (4, "lonely"), (5, None), (6, "--- \x00"), (7, say(25))]
    items += [(8, items[0][1]), (9, items[0][1] + " more")]
    docs = [(i, " ".join(r.choice([say(7), *[t for _, t in items if t]]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    docs += [(7, None), (7, ""), (None, "so lonely, ONE-two"), (99, items[8][1] * 40), (100, "lonelyx one"), (101, "lonely\x00")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA), spark.createDataFrame([(*i, "clash") for i in items], "item_id int, text string, doc_id string")


def test_every_window_is_found(spark):
    docs, items = case()
    d, b = frames(spark, docs, items)
    want = sorted(map(repr, brute(docs, items)))
    assert sorted(repr(tuple(r)) for r in D.contamination(d, b).collect()) == want
    assert any(r[2] for r in brute(docs, items))
    # a benchmark of several blocks
    assert sorted(repr(tuple(r)) for r in D.contamination(d, b, size=100).collect()) == want
    clean = [(i, t) for (i, t), row in zip(docs, brute(docs, items)) if not row[2]]
    for size in (D.BLOCK, 100):
        kept = D.decontaminated(d, b, size=size)
        assert kept.columns == d.columns and sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(repr, clean))


def test_longest_matches_and_places(spark):
    docs, items = case(5)
    items = [i for i in items if i[0] != 2 and i[1]]
    d, b = frames(spark, docs, items)
    found = {(r.item_id, r.item_word): r for r in D.longest_matches(d, b).collect()}
    for item, text in items:
        v = words(text)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            best = count = 0
            for _, t in docs:
                w = words(t)
                for j in range(len(w) - n + 1):
                    k = 0
                    while i + k < len(v) and j + k < len(w) and v[i + k] == w[j + k]:
                        k += 1
                    best, count = max(best, k), count + (k >= n)
            row = found.get(("" if item is None else str(item), i))
            assert (row.n_words, row.n_locations) == (best, count) if count else row is None


def test_empty_tables(spark):
    docs, items = case()
    d, b = frames(spark, docs, items)
    assert D.contamination(d.limit(0), b).collect() == []
    rows = D.contamination(d, b.limit(0)).collect()
    assert len(rows) == len(docs) and not any(r.contaminated for r in rows)


def test_a_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(3000))
    text = " ".join(f"f{i % 977}" for i in range(400_000)) + " " + item
    d = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    rows = {r.doc_id: r for r in D.contamination(d, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[2].n_hit) == (403_000, 3000, 0)


def test_suffixes_are_sorted():
    r = np.random.default_rng(1)
    w = np.concatenate([r.integers(1, 4, 500), np.zeros(40, np.int64)]).astype(np.uint64)
    order = D.suffix_array(w, np.arange(500), 40)
    key = lambda p: w[p : p + 40].tolist()
    assert sorted(order.tolist()) == list(range(500)) and all(key(a) <= key(b) for a, b in zip(order[:-1], order[1:]))
