"""Repair of conversations by grammar-compressed dynamic programming.

A conversation is a string of symbols, one for each row: the class of its role and its
first fault. Symbols that often stand together become rules of a Re-Pair grammar over the
distinct strings of all conversations; a round of counting takes all frequent pairs that
share no symbol. The cheapest edits of a string are a product of min-plus matrices over the
states of the grammar of roles, `(s?(ua)+)?`, whose entries are a cost and an audit, the
edits' initials as a rope. A rule's matrix is the product of its two parts', computed once,
bottom-up, and shared by all conversations that hold it. Of equal costs the ASCII-least
audit stays; two audits of equal cost for the same symbols are never one the beginning of
the other, so the least of a whole is made of the least of its parts.

Rows are dealt and sorted by ranges of (conversation, turn, role, digest), so that one long
conversation spreads over tasks, and packed into segments. Only segments meet in one task
by conversation, streamed: a digest of an ordered text can't be made otherwise.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, kept, lean, ship

ROLES, FAULTS = "sua", ("fine", "truncated", "blank", "duplicate")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: rows and characters of a segment; one text may be larger
SEGMENT, CHARS = 512, 1 << 20
#: rounds of the grammar, pairs of a round, and distinct segments that a worker remembers
RULES, ROUND, MEMO = 8, 32, 50_000
SPACE = r"\x20\x09-\x0D"
#: states: nothing yet, after s, after u, after a; what a role leads to from each
START, NEXT = 0, {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
DONE = (0, 3)
LEGAL = {"su", "ua", "au"}


class Rope:
    """A text made of two others, joined when it is first read."""

    __slots__ = ("parts", "size")

    def __init__(self, *parts):
        self.parts, self.size = parts, sum(map(len, parts))

    def __len__(self):
        return self.size

    def __str__(self):
        if len(self.parts) != 1 or not isinstance(self.parts[0], str):
            out, stack = [], [self]
            while stack:
                top = stack.pop()
                if isinstance(top, str):
                    out.append(top)
                else:
                    stack.extend(reversed(top.parts))
            self.parts = ("".join(out),)
        return self.parts[0]


def better(a, b):
    """The cheaper of two (cost, audit), of equal ones the one with the lesser audit."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if str(a[1]) <= str(b[1]) else b


def times(left, right):
    """The min-plus product: for each pair of states the best way through a third."""
    out = [[None] * 4 for _ in range(len(left))]
    for p, row in enumerate(left):
        for q, a in enumerate(row):
            if a is not None:
                for r, b in enumerate(right[q]):
                    if b is not None:
                        out[p][r] = better(out[p][r], (a[0] + b[0], Rope(a[1], b[1])))
    return out


def _inserts():
    step = [[None] * 4 for _ in range(4)]
    for role in "ua":
        for p, q in NEXT[role].items():
            step[p][q] = (INSERT, Rope("I"))
    stay = [[(0, Rope("")) if p == q else None for q in range(4)] for p in range(4)]
    once = [[better(stay[p][q], step[p][q]) for q in range(4)] for p in range(4)]
    return times(once, once)  # more inserts than two lead nowhere new


INSERTS = _inserts()


class Part:
    """What a run of symbols does: its matrix, and counts of faults and illegal neighbours."""

    __slots__ = ("matrix", "counts", "illegal", "first", "last")

    def __init__(self, matrix, counts, illegal, first, last):
        self.matrix, self.counts, self.illegal, self.first, self.last = matrix, counts, illegal, first, last

    def __add__(self, other):
        return Part(times(self.matrix, other.matrix), [a + b for a, b in zip(self.counts, other.counts)], self.illegal + other.illegal + (self.last + other.first not in LEGAL), self.first, other.last)


def symbol(role: str, fault: int) -> str:
    number = ROLES.find(role[0]) if role else -1
    return chr(ord("A") + 4 * (number if number >= 0 else len(ROLES)) + fault)


def terminal(char: str) -> Part:
    number, fault = divmod(ord(char) - ord("A"), 4)
    role, more = (ROLES + "o")[number], TRUNCATED * (FAULTS[fault] == "truncated")
    edit = [[None] * 4 for _ in range(4)]
    for p in range(4):
        edit[p][p] = (DELETE, Rope("D"))
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        for r in "ua":
            if p in NEXT[r]:
                edit[p][NEXT[r][p]] = better(edit[p][NEXT[r][p]], (REROLE + more, Rope("R")))
        if p in NEXT.get(role, {}):
            edit[p][NEXT[role][p]] = better(edit[p][NEXT[role][p]], (KEEP + more, Rope("K")))
    return Part(times(INSERTS, edit), [int(fault == k) for k in (2, 3, 1)], 0, role, role)


class Grammar:
    """Rules (pair, symbol) in order, and what every symbol does."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.parts = {c: terminal(c) for c in map(chr, range(ord("A"), ord("A") + 16))}
        for pair, name in rules:
            self.parts[name] = self.parts[pair[0]] + self.parts[pair[1]]
            for row in self.parts[name].matrix:  # ropes of rules are short: read once here
                for entry in row:
                    if entry is not None:
                        str(entry[1])

    def compressed(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def part(self, symbols: str, memo: dict) -> Part:
        """A segment's part; distinct segments are evaluated once for each worker and filling."""
        if symbols not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            first, *rest = self.compressed(symbols)
            out = self.parts[first]
            for c in rest:
                out = out + self.parts[c]
            memo[symbols] = out
        return memo[symbols]


def _pairs(grammar: Grammar):
    def run(batches):
        counts = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                s = grammar.compressed(s)
                counts.update(map("".join, zip(s, s[1:])))
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["pair", "n"])

    return run


def re_pair(strings: DataFrame, rounds: int = RULES, most: int = ROUND) -> Grammar:
    """A grammar of distinct strings (column symbols). The driver gets at most 8 * ``most``
    pairs a round; how many rules there are changes the cost and no result."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        found = strings.mapInArrow(lean(_pairs(Grammar(rules))), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = found.where("n > 3").orderBy(F.desc("n"), "pair").limit(8 * most).collect()
        used, fresh = set(), []
        for row in top:
            if len(fresh) < most and not used & set(row["pair"]):
                used |= set(row["pair"])
                fresh.append((row["pair"], chr(0x100 + len(rules) + len(fresh))))
        if not fresh:
            break
        rules = rules + fresh
    return Grammar(rules)


# ---------------------------------------------------------------- segments


def faults(role: Column, text: Column) -> Column:
    """0 fine, 1 truncated, 2 blank, by the text alone."""
    return F.when(~text.rlike(f"[^{SPACE}]"), 2).when(~text.rlike(rf"[.!?][{SPACE}]*\z"), 1).otherwise(0)


def _segments(batches, most: int):
    """Sorted rows and marks to segments: a mark says that the row after it is the first
    with its role and text."""
    task, n, now, first = TaskContext.get().partitionId(), 0, None, False
    symbols, roles, texts, turns, chars = [], [], [], [], 0

    def row():
        known = [t for t in turns if t is not None]
        distinct = len(set(known))
        values = [[now], [task], [n], ["".join(symbols)], [roles], [texts], [known[0] if known else None], [known[-1] if known else None], [distinct]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    names = ["conv_id", "task", "n", "symbols", "roles", "texts", "low", "high", "turns"]
    for batch in batches:
        types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
        for conv, turn, role, text, kind, fault in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind", "fault"))):
            if not kind:
                first = True
                continue
            if symbols and (conv != now or len(symbols) >= most or chars >= CHARS):
                yield row()
                n += 1
                symbols, roles, texts, turns, chars = [], [], [], [], 0
            now = conv
            symbols.append(symbol(role, fault if fault == 2 or first else 3))
            roles.append(role)
            texts.append(text)
            turns.append(turn)
            chars += len(text)
            first = False
    if symbols:
        yield row()


def segments(turns: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Rows packed, at most so many together, in order of their turn (null first), role and digest of the text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    marks = rows.groupBy("conv_id", "role", "sha").agg(earliest.alias("at"))
    marks = marks.select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit("").alias("text"), "sha", F.lit(0).alias("kind"), F.lit(0).alias("fault"))
    both = rows.select("*", F.lit(1).alias("kind"), faults(F.col("role"), F.col("text")).alias("fault")).unionByName(marks)
    order = ["conv_id", "turn", "role", "sha"]
    kind = turns.schema["conv_id"].dataType.simpleString()
    packed = both.repartitionByRange(*order).sortWithinPartitions(*order, "kind").drop("sha")
    return packed.mapInArrow(lean(lambda batches: _segments(batches, most)), f"conv_id {kind}, task long, n long, symbols string, roles array<string>, texts array<string>, low long, high long, turns long")


# ---------------------------------------------------------------- edits


def _shared(states: list) -> tuple[str, list]:
    """What the audits of all states begin with, and the states without it."""
    live = [str(s[1]) for s in states if s is not None]
    a, b = min(live), max(live)
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n], [s and (s[0], Rope(str(s[1])[n:])) for s in states]


def _folded(grammar: Grammar):
    """Segments in order of conversation, without their texts, to a row for each conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        memo = kept(("repair",))
        now, begun = None, False

        def row():
            best = None
            for q, end in enumerate(times([states], INSERTS)[0]):
                if q in DONE:
                    best = better(best, end)
            gaps = high - low + 1 - distinct if low is not None else 0
            values = [now, gaps, *counts, illegal, best[0], "".join(out) + str(best[1])]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for conv, symbols, first, final, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "symbols", "low", "high", "turns"))):
                if not begun or conv != now:
                    if begun:
                        yield row()
                    begun, now, states, out = True, conv, [(0, Rope("")), None, None, None], []
                    counts, illegal, last, low, high, distinct = [0, 0, 0], 0, None, None, None, 0
                if symbols:
                    part = grammar.part(symbols, memo)
                    head, states = _shared(times([states], part.matrix)[0])
                    out.append(head)
                    counts = [a + b for a, b in zip(counts, part.counts)]
                    illegal += part.illegal + (last is not None and last + part.first not in LEGAL)
                    last = part.last
                if first is not None:
                    distinct += n - (high == first)
                    low, high = (first if low is None else low), final
        if begun:
            yield row()

    return run


def apply_edits(audit: str, rows):
    """The (role, text) that an audit makes of rows, which may come one by one."""
    edits, state, rows = iter(audit), START, iter(rows)
    for edit in edits:
        if edit == "I":
            role = "a" if state == 2 else "u"
            yield "assistant" if role == "a" else "user", ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == 2 else "user"
            yield role, text
            role = role[:1]
        state = NEXT[role][state]
    for _ in rows:
        raise ValueError("an audit ended before its rows")


def _rendered(report: bool):
    """A conversation's audit, then its segments, to its digest or to its repaired turns."""
    fields = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def grouped(batches):
        """(row of the audit, its turns) for each conversation, streamed."""
        flat = ((batch, i) for batch in batches for i in range(batch.num_rows))
        ahead = next(flat, None)

        def turns():
            nonlocal ahead
            while ahead is not None and not ahead[0].column("head")[ahead[1]].as_py():
                batch, i = ahead
                yield from zip(batch.column("roles")[i].as_py(), batch.column("texts")[i].as_py())
                ahead = next(flat, None)

        while ahead is not None:
            batch, i = ahead
            head = [batch.column(c)[i].as_py() for c in fields]
            types = [batch.schema.field(c).type for c in fields]
            ahead = next(flat, None)
            yield head, types, turns()

    def run(batches):
        for head, types, turns in grouped(batches):
            made = apply_edits(head[-1] or "", turns)
            if report:
                sha = hashlib.sha256()
                for k, (role, text) in enumerate(made):
                    sha.update(f"{chr(10) if k else ''}{role}:{text}".encode(errors="replace"))
                yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(head, types)), pa.array([sha.hexdigest()])], [*fields, "repaired_sha256"])
                continue
            for k, (role, text) in enumerate(made):
                values = [(head[0], types[0]), (k, pa.int64()), (role, pa.string()), (text, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["conv_id", "position", "role", "text"])

    return run


def _run(turns: DataFrame, ids: DataFrame | None, report: bool, most: int = SEGMENT) -> DataFrame:
    spark = turns.sparkSession
    ship(spark)
    packed = cut(segments(turns, most), "segments")
    grammar = re_pair(cut(packed.select("symbols").distinct(), "strings"))
    kind = packed.schema["conv_id"].dataType.simpleString()
    light = packed.select("conv_id", "task", "n", "symbols", "low", "high", "turns")
    # conversations of which no row is left still get a row
    every = (turns if ids is None else ids).select("conv_id").distinct()
    none = F.lit(None).cast("long")
    light = light.unionByName(every.select("conv_id", F.lit(-1).cast("long").alias("task"), F.lit(0).cast("long").alias("n"), F.lit("").alias("symbols"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("turns")))
    light = light.repartition("conv_id").sortWithinPartitions("conv_id", "task", "n")
    figures = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    heads = cut(light.mapInArrow(lean(_folded(grammar), ("repair",)), f"conv_id {kind}, {figures}"), "audits")
    names = [f.split()[0] for f in figures.split(", ")]
    heads = heads.withColumn("head", F.lit(True)).withColumn("task", F.lit(-1).cast("long")).withColumn("n", F.lit(0).cast("long"))
    body = packed.select("conv_id", "task", "n", "roles", "texts", F.lit(False).alias("head"))
    both = heads.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "task", "n")
    schema = f"conv_id {kind}, {figures}, repaired_sha256 string" if report else f"conv_id {kind}, position long, role string, text string"
    return both.select("conv_id", *names, "head", "roles", "texts").mapInArrow(lean(_rendered(report)), schema)


def repair_report(turns: DataFrame, ids: DataFrame | None = None, most: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of
    each conversation of ``turns`` (conv_id, turn, role, text), or of ``ids`` where given.

    Null roles and texts count as one space; rows without a conv_id are one conversation.
    Rows go by turn, null first; those of one turn by role and digest of the text, repeated
    rows next to each other. Without rows: zeros, an empty audit and the digest of nothing.
    An empty table gives no rows; texts and conversations of any length are whole, and
    other columns are not read. ``most`` rows make a segment, whatever the result. A turn whose number does not fit a long is an error.
    """
    return _run(turns, ids, True, most)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role and text of the repaired conversations."""
    return _run(turns, None, False)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: a row is dropped, its
    text emptied, its ends of sentences removed, the row repeated, or its role set to user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), text.alias("text"), h.alias("_h")).where("_h <> 0")
    twice = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", twice.alias("_copy")).drop("_copy")
