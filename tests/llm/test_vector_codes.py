"""Vector codes against a full search in Python integers."""

import hashlib
import math
import random

import numpy as np

from siftline.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == size]
    at, top = [i * size // 4 for i in range(5)], V.largest(size)
    ints = [[max(-top, min(top, math.floor(1024 * float(np.float32(x))))) for x in r[1]] for r in rows]
    parts = [[x[at[p] : at[p + 1]] for x in ints] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            got = {}
            for x in parts[p]:
                got.setdefault(near(x, books[p])[1], []).append(x)
            for i, xs in got.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    out, totals = [], {}
    for k, r in enumerate(rows):
        found = [near(parts[p][k], books[p]) for p in range(4)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
        totals[r[2]] = totals.get(r[2], 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((v, c, e, totals[label], sha) for v, c, e, label in out), key=repr)


def rows(n, size, seed=1):
    r = random.Random(seed)
    out = [(i, [r.choice([-0.5, 0.25, r.gauss(0, 0.3)]) for _ in range(size)], r.choice([None, 1, 2])) for i in range(n)]
    out += [(5, out[5][1], 9), (None, out[7][1], None), (n, None, 1), (n + 1, [], 1), (n + 2, [None] * size, 1), (n + 3, [math.nan] + [0.0] * (size - 1), 2)]
    return out + [(n + 4, [math.inf] * size, 2), (n + 5, [0.1] * (size + 1), 2), (3, out[3][1], 1)]


def compressed(spark, given):
    table = spark.createDataFrame([(*r, "clash") for r in given], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in V.compress(table).collect()), key=repr)


def test_codes_equal_a_full_search(spark):
    given = rows(330, 8)
    assert compressed(spark, given) == brute(given)


def test_few_vectors_uneven_parts_and_large_components(spark):
    given = rows(12, 6, 2) + [(40, [1e30, -1e30, 3e6, 0.0, 1.0, 5e5], 4), (41, [-1e30] * 6, 4)]
    assert compressed(spark, given) == brute(given)
    assert compressed(spark, [r for r in given if not r[1]]) == []
    assert compressed(spark, []) == []


def test_bounds_skip_entries_and_miss_none():
    r = np.random.default_rng(4)
    entries = r.integers(-300, 300, (256, 16))
    x = entries[r.integers(0, 256, 5000)] + r.integers(-40, 40, (5000, 16))
    pivots = V.far_apart(entries, V.PIVOTS)
    book = V.Codebook(entries, pivots, int(np.abs(x).max()))
    codes, d = book.nearest(x, np.stack([V.to_pivot(x, p) for p in pivots], axis=1))
    whole = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (codes == whole.argmin(axis=1)).all() and (d == whole.min(axis=1)).all()
    assert book.evaluated < 0.5 * whole.size


def test_totals_of_frequent_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(V, "LABELS", 3)
    table = spark.createDataFrame([(None if i % 3 == 0 else i % 50, i) for i in range(300)], "label int, error long")
    got = V.with_totals(table, "label", "error", "total").collect()
    sums = {}
    for r in table.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert len(got) == 300 and all(r.total == sums[r.label] for r in got)
