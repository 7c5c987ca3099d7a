"""Secret scans with DataFrame functions alone.

Base kinds are patterns. Their positions come from marks put around each match and
lengths of what lies between the marks, so all offsets are code points and all of it runs
in the JVM. A character Markov model of random strings and one of ordinary identifiers,
trained from labelled samples, add spans: a long run of key characters whose mean
log-likelihood ratio per transition passes a threshold is a span of kind ``markov``. The
threshold is calibrated on the labelled samples; nothing but the ratio decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, fresh_name

#: fixed values: the base kinds, in their order. Each pattern has two groups; a match whose
#: second group is shorter than the number is dropped.
KINDS = {
    "assign": (r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"()(AKIA[A-Z0-9]+)", 20),
    "hex": (r"()([0-9a-f]{24,})", 24),
}
MARKOV = r"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+)"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
#: marks around matches; the same characters in a text are replaced by a fourth before
BEGIN, MIDDLE, END, OTHER = "\x01", "\x02", "\x03", "\x04"
SPAN = "array<struct<start: long, kind_no: int, end: long, kind: string>>"
#: values of a block of an array, and characters of a chunk of a text
BLOCK, CHUNK = 32, 4096


def unmarked(text: Column) -> Column:
    """The text without our marks, of the same length."""
    text = F.coalesce(text, F.lit(""))
    has = text.contains(BEGIN) | text.contains(MIDDLE) | text.contains(END)
    return F.when(has, F.translate(text, BEGIN + MIDDLE + END, OTHER * 3)).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array<struct<start, head, value>>, where head
    and value are the match's two groups."""
    marked = F.regexp_replace(text, pattern, f"{BEGIN}$1{MIDDLE}$2{END}")
    kind = "array<struct<start: long, head: string, value: string>>"

    def cut(parts: Column) -> Column:
        lengths = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.length(p).cast("long") - 2)
        starts = running(lengths, F.length(F.get(parts, F.lit(0))).cast("long"), lambda a, b: a + b)

        def match(part, start):
            value = F.substring_index(F.substring_index(part, END, 1), MIDDLE, -1)
            return F.struct(start.alias("start"), F.substring_index(part, MIDDLE, 1).alias("head"), value.alias("value"))

        return F.zip_with(F.slice(parts, 2, F.size(parts)), starts, match).cast(kind)

    return F.when(text.rlike(pattern), once(F.split(marked, BEGIN), cut)).otherwise(F.array().cast(kind))


def once(value: Column, use: Callable) -> Column:
    """``use`` of a value that is computed once, however often it is named: a lambda's
    variable is bound, an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, begin: Column, combine: Callable, levels: int = 2) -> Column:
    """For each long of an array what ``combine`` makes of ``begin`` and those before it.
    Blocks have their totals first, whose running values begin the blocks, so that the time
    grows with the array and not with its square."""

    def within(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), combine))
        starts = running(totals, begin, combine, levels - 1) if levels else simple(totals, begin)
        one = lambda b, at: F.transform(b, lambda _, i: F.aggregate(F.slice(b, 1, i), at, combine))
        return F.flatten(F.zip_with(blocks, starts, one))

    def simple(all_values: Column, at: Column) -> Column:
        return F.transform(all_values, lambda _, i: F.aggregate(F.slice(all_values, 1, i), at, combine))

    def blocked(all_values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_values), F.lit(1)) - 1) / BLOCK).cast("int"))
        return once(F.transform(numbers, lambda n: F.slice(all_values, n * BLOCK + 1, BLOCK)), within)

    return once(values, blocked)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then kind."""
    kinds = []
    for number, (kind, (pattern, least)) in enumerate(KINDS.items()):
        kept = F.filter(matches(text, pattern), lambda m: F.length(m["value"]) >= least)
        kinds.append(
            F.transform(
                kept,
                lambda m: F.struct(
                    m["start"].alias("start"), F.lit(number).alias("kind_no"),
                    (m["start"] + F.length(m["head"]) + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind"),
                ),
            )
        )
    return F.array_sort(F.concat(*kinds))


def transitions(token: Column) -> Column:
    """The cells of a token's character pairs, in order; each character is looked at once."""
    symbols = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    pair = lambda a, b: a * SIDE + b
    return once(symbols, lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), pair))


def labelled_tokens(docs: DataFrame, documents: int = 2000) -> DataFrame:
    """Labelled samples (token, random) of at most about ``documents`` documents, chosen
    by a hash of doc_id: values of base spans are random strings, words of eight or more
    key characters outside them ordinary identifiers."""
    n = max(docs.count(), 1)
    share = min(1.0, documents / n)
    most = int(share * (1 << 62)) * 2 - (1 << 62) * 1
    text = unmarked(F.col("text"))
    rows = docs.where((F.xxhash64("doc_id") / 2 <= F.lit(float(most))) if share < 1 else F.lit(True)).select(text.alias("text"))
    found = [F.filter(matches(F.col("text"), p), lambda m, least=least: F.length(m["value"]) >= least) for p, least in KINDS.values()]
    rows = rows.select("text", F.flatten(F.array(*(F.transform(f, lambda m: m["value"]) for f in found))).alias("values"))
    random = rows.select(F.explode("values").alias("token"), F.lit(True).alias("random"))
    rest = F.col("text")
    for pattern, _ in KINDS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    plain = F.regexp_extract_all(rest, F.lit("(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{8,}+)"), F.lit(1))
    plain = rows.select(F.explode(F.array_distinct(plain)).alias("token"), F.lit(False).alias("random"))
    return random.union(plain)


class Markov:
    """Log-likelihood ratios of character transitions, random against ordinary."""

    def __init__(self, labelled: DataFrame, alpha: float = 0.5):
        labelled = cut(labelled, "labelled")
        pairs = labelled.where("length(token) > 1").select("random", F.explode(transitions(F.col("token"))).alias("cell"))
        counts = pairs.groupBy("cell", "random").count().collect()  # at most 2 * SIDE**2 rows
        table = {True: [0] * SIDE**2, False: [0] * SIDE**2}
        for row in counts:
            table[row["random"]][row["cell"]] = row["count"]
        self.trained = any(table[True]) and any(table[False])
        self.ratios = []
        for a in range(SIDE):
            rows = {k: t[a * SIDE : (a + 1) * SIDE] for k, t in table.items()}
            total = {k: sum(r) + alpha * SIDE for k, r in rows.items()}
            self.ratios += [
                math.log((rows[True][b] + alpha) / total[True]) - math.log((rows[False][b] + alpha) / total[False]) for b in range(SIDE)
            ]
        self.least = self.calibrated(labelled) if self.trained else 0.0

    def calibrated(self, labelled: DataFrame) -> float:
        """The mean ratio halfway between what one random sample in a hundred falls below
        and what one ordinary sample in a hundred exceeds, at least 0."""
        rated = labelled.where("length(token) > 1").select("random", self.mean_ratio(F.col("token")).alias("ratio"))
        row = rated.agg(
            F.percentile_approx(F.when(F.col("random"), F.col("ratio")), 0.01).alias("low"), F.percentile_approx(F.when(~F.col("random"), F.col("ratio")), 0.99).alias("high")
        ).first()
        return max(0.0, (row["low"] + row["high"]) / 2)

    def mean_ratio(self, token: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")
        sums = F.aggregate(transitions(token), F.lit(0.0), lambda acc, cell: acc + F.get(table, cell))
        return sums / (F.length(token) - 1)

    def spans(self, text: Column, base: Column, least: float | None = None) -> Column:
        if not self.trained:
            return F.array().cast(SPAN)
        least = self.least if least is None else least
        free = F.transform(
            matches(text, MARKOV),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), (m["start"] + F.length(m["value"])).alias("end"),
                F.lit("markov").alias("kind"), m["value"].alias("value"),
            ),
        )
        likely = F.filter(free, lambda s: self.mean_ratio(s["value"]) >= least)
        # a run meets a base span if one that begins before its end ends after its start:
        # in order of begins and ends, the furthest end so far tells
        runs = F.transform(likely, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).cast("long").alias("to"), s["start"].alias("start")))
        bases = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("to"), b["start"].alias("start")))

        def clear(events: Column) -> Column:
            furthest = running(F.transform(events, lambda e: e["to"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
            span = lambda e: F.struct(e["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), e["at"].alias("end"), F.lit("markov").alias("kind"))
            return F.array_compact(F.zip_with(events, furthest, lambda e, to: F.when((e["base"] == 0) & (to <= e["start"]), span(e))))

        found = F.when(F.size(runs) > 0, once(F.array_sort(F.concat(runs, bases)), clear)).otherwise(F.array())
        return found.cast(SPAN)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, documents: int = 2000, least: float | None = None, base: str = "base", found: str = "found") -> DataFrame:
    """``docs`` with two more columns, the base spans and all spans in order; other columns
    of these names are replaced, so give names that ``docs`` doesn't have."""
    model = Markov(labelled_tokens(docs.select("doc_id", "text"), documents))
    text = fresh_name(docs, "_text")
    rows = docs.withColumn(text, unmarked(F.col("text")))
    rows = rows.withColumn(base, base_spans(F.col(text)))
    return rows.withColumn(found, F.array_sort(F.concat(base, model.spans(F.col(text), F.col(base), least)))).drop(text)


def scan_secrets(docs: DataFrame, documents: int = 2000, least: float | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    A null text counts as empty and has no spans: an empty string, and the digest of one.
    Offsets are code points. Rows that repeat a doc_id each give a row; an empty table
    gives none. Without labelled samples of both kinds no markov spans are added. Texts,
    tokens and numbers of matches may be of any size: the time grows with them. Columns
    other than doc_id and text are not read.
    """
    rows = with_spans(docs.select("doc_id", "text"), documents, least)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mask``; spans that overlap count as one. The
    text is cut into chunks first, so that a span costs what lies between it and the next
    and a chunk at most."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def masked(chunks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), (a - F.lit(CHUNK) * first + 1).cast("int"), (b - a).cast("int"))

        furthest = running(F.transform(spans, lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(spans, furthest, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit(mask))).otherwise(""))
        end = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: F.greatest(acc, s["end"]))
        return F.concat(F.array_join(pieces, ""), between(end, F.length(text).cast("long")))

    return F.when(F.size(spans) == 0, text).otherwise(once(chunks, masked))
