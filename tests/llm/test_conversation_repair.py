"""Repair of conversations against a search of all edits, without grammar or matrices."""

import hashlib
import heapq
import random

import pytest

from siftline.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def judged(rows):
    """rows in order: (role, text, fault)."""
    seen, out = set(), []
    for role, text in rows:
        inside = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else "fine"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """Dijkstra over (rows done, state), least cost, then least audit."""
    after = lambda s, c: {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(c, {}).get(s)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, s, made = heapq.heappop(heap)
        if (i, s) in done and not audit:
            continue
        if i == len(rows) and s in (0, 3):
            return cost, audit, list(made)
        if (i, s, audit) in done or len(audit) > 2 * len(rows) + 2:
            continue
        done.add((i, s, audit))
        for c, name in (("u", "user"), ("a", "assistant")):
            if after(s, c) is not None:
                heapq.heappush(heap, (cost + 2, audit + "I", i, after(s, c), (*made, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, made))
            more = fault == "truncated"
            if fault in ("fine", "truncated"):
                if after(s, role[:1]) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after(s, role[:1]), (*made, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if after(s, c) is not None:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, after(s, c), (*made, f"{name}:{text}")))


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=key)
    turns = {t for t, _, _ in rows if t is not None}
    parts = judged([r[1:] for r in rows])
    cost, audit, made = cheapest(parts)
    n = lambda f: sum(p[2] == f for p in parts)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(), made


def conversations():
    r = random.Random(11)
    out = {}
    for c in range(40):
        roles = ["user", "assistant", "system", "tool", "", None, "ärger", "u"]
        texts = ["hi.", "so", "", " \t", None, "why?\n", "no!"] + [f"line {c}."]
        turn = lambda: r.choice([None, *range(9)])
        out[c] = [(turn(), r.choice(roles[: r.choice([2, 3, 8])]), r.choice(texts)) for _ in range(r.randint(0, 7))]
    out[None] = [(1, "user", "a."), (2, "assistant", "b.")]
    out[77] = [(1, "user", "same."), (1, "user", "same."), (2, "assistant", "done.")]
    return out


@pytest.mark.parametrize("most", [2, 512])
def test_edits_are_the_cheapest(spark, most):
    given = conversations()
    turns = spark.createDataFrame([(c, *row, "clash") for c, rows in given.items() for row in rows], SCHEMA)
    ids = spark.createDataFrame([(c,) for c in given], "conv_id long")
    found = {r.conv_id: tuple(r)[1:] for r in C.repair_report(turns, ids, most).collect()}
    assert set(found) == set(given)
    for c, rows in given.items():
        assert found[c] == brute(rows)[:-1], (c, rows)
    if most == 512:
        made = {}
        for r in C.repaired_turns(turns).orderBy("conv_id", "position").collect():
            made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert made == {c: brute(rows)[-1] for c, rows in given.items() if brute(rows)[-1]}


def test_one_long_conversation(spark):
    n = 6000
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.", "") for i in range(n)]
    rows[3001] = (5, 3001, "user", "turn 3001", "")
    got = C.repair_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.gaps, got.illegal, got.truncated, got.cost) == (0, 2, 1, 3)
    assert got.audit == "K" * 3001 + "R" + "K" * (n - 3002)


def test_empty_table_and_damage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(empty).collect() == [] and C.repaired_turns(empty).collect() == []
    import zlib

    rows = [(c, t, "assistant", f"a. {c} b") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    got = sorted(map(repr, (tuple(r) for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())))
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if h == 1 else text.replace(".", "") if h == 2 else text
        want += [repr((c, t, "user" if h == 4 else role, text))] * (0 if h == 0 else 2 if h == 3 else 1)
    assert got == sorted(want)


def test_rules_equal_their_symbols():
    grammar = C.Grammar([("EI", chr(256)), (chr(256) * 2, chr(257))])
    text = "EIEIEIEIAKEI"
    whole, plain = grammar.part(text, {}), C.Grammar([]).part(text, {})
    shown = lambda p: [[e and (e[0], str(e[1])) for e in row] for row in p.matrix]
    assert grammar.compressed(text) != text and shown(whole) == shown(plain)
    assert (whole.counts, whole.illegal) == (plain.counts, plain.illegal)
