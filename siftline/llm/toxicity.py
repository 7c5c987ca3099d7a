"""Toxicity by a learned lexicon, misspellings and the context of each hit.

The lexicon is learned from a bounded sample of labelled rows: whole words and stems
(common beginnings of several words) that toxic rows hold far more often than others.
Whole words go into a trie. A Levenshtein automaton is intersected with it by running sets
of (trie node, edits so far) over a word; the sets seen are numbered, which makes a
deterministic automaton that grows as needed and drops most words after a few characters.
Each hit is weighed by its context window: inside quotation marks less, near second-person
words more. A logistic model on a held-back part of the sample makes the score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import lean, ship

SAMPLE = 20_000
LEXICON = 3_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)
WINDOW = 60
QUOTED, DIRECT = 0.5, 1.25
#: fixed values: second-person words
SECOND_PERSON = {"you", "your", "youre", "yours", "u", "du", "dich", "dir", "ihr", "tu", "te", "toi", "vous", "usted", "ti"}
QUOTES = re.compile("[\"“”«»„]")
LIMIT = 500_000


class LexiconAutomaton:
    """Levenshtein automata of at most one edit, intersected with a trie of terms."""

    def __init__(self, terms: dict[str, float], fuzzy_from: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.fuzzy.append(False)
                node = self.children[node][c]
            self.term[node] = term
            self.fuzzy[node] = len(term) >= fuzzy_from
        self.terms = terms
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, str] | None] = []
        self.start = self.number({(0, 0)})

    def number(self, states: set) -> int:
        """The automaton's state for a set of (node, edits), closed under skipped letters."""
        full = set(states)
        for node, edits in states:
            if edits == 0:
                full.update((child, 1) for child in self.children[node].values())
        full = frozenset((n, e) for n, e in full if e == 0 or (n, 0) not in full)
        if full not in self.numbers:
            self.numbers[full] = len(self.sets)
            self.sets.append(full)
            self.steps.append({})
            found = [(self.terms[self.term[n]], self.term[n]) for n, e in full if self.term[n] is not None and (e == 0 or self.fuzzy[n])]
            self.accepts.append(max(found, default=None))
        return self.numbers[full]

    def step(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, edits))
            if edits == 0:
                after.add((node, 1))  # a letter too many
                after.update((x, 1) for x in self.children[node].values())  # another letter
        self.steps[state][c] = found = self.number(after) if after else -1
        return found

    def match(self, word: str) -> tuple[float, str] | None:
        """The heaviest term within one edit (short terms: none) of ``word``."""
        state = self.start
        for c in word:
            after = self.steps[state].get(c)
            state = self.step(state, c) if after is None else after
            if state < 0:
                return None
        return self.accepts[state]


class Scorer:
    """Features of a text under a lexicon: {term: weight} and {stem: weight}."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.automaton, self.stems, self.known = LexiconAutomaton(words), stems, {}

    def weight(self, word: str) -> float:
        best = max((self.stems.get(word[:k], 0.0) for k in STEMS if k <= len(word)), default=0.0)
        hit = self.automaton.match(word)
        return max(best, hit[0] if hit else 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log(1 + weight of distinct hits), the heaviest hit, log(1 + hits per 100 words)."""
        text = (text or "").lower()
        words = WORD.findall(text)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > LIMIT:
                known.clear()
                new = set(words)
            known.update((w, self.weight(w)) for w in new)
        if not any(map(known.__getitem__, words)):
            return 0.0, 0.0, 0.0
        best: dict[str, float] = {}
        for m in WORD.finditer(text):
            w = known[m[0]]
            if w:
                best[m[0]] = max(best.get(m[0], 0.0), w * self.context(text, m.start(), m.end()))
        hits = sum(1 for w in words if known[w])
        return float(np.log1p(sum(best.values()))), max(best.values()), float(np.log1p(100 * hits / len(words)))

    @staticmethod
    def context(text: str, start: int, end: int) -> float:
        """What the window around a hit makes of it."""
        before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        before, after = before.rpartition("\n")[2], after.partition("\n")[0]
        factor = QUOTED if len(QUOTES.findall(before)) % 2 and QUOTES.search(after) else 1.0
        near = WORD.findall(before)[-5:] + WORD.findall(after)[:5]
        return factor * DIRECT if SECOND_PERSON.intersection(near) else factor


def entries(text: str) -> set[str]:
    """Whole words (marked by a final space) and stems of a text."""
    found = set()
    for w in set(WORD.findall(text.lower())):
        if 3 <= len(w) < 40:
            found.add(w + " ")
            found.update(w[:k] for k in STEMS if k < len(w))
    return found


def _entry_counts(batches):
    counts: dict[str, list[int]] = {}

    def rows():
        terms = list(counts)
        values = [counts[t] for t in terms]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([v[i] for v in values], pa.int64()) for i in (0, 1))], ["entry", "clean", "toxic"]
        )

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for e in entries(text or ""):
                counts.setdefault(e, [0, 0])[1 if toxic else 0] += 1
        if len(counts) > LIMIT:
            yield rows()
    yield rows()


def chosen(rows, n_clean: int, n_toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """The lexicon from candidate rows (entry, clean, toxic). A stem is kept only if
    no single word explains it."""
    weight = {r[0]: float(np.log((r[2] + 0.5) / (n_toxic + 1)) - np.log((r[1] + 0.5) / (n_clean + 1))) for r in rows}
    toxic = {r[0]: r[2] for r in rows}
    words = {e[:-1]: w for e, w in weight.items() if e[-1] == " "}
    most: dict[str, int] = {}
    for w in words:
        for k in STEMS:
            if k < len(w):
                most[w[:k]] = max(most.get(w[:k], 0), toxic[w + " "])
    stems = {e: w for e, w in weight.items() if e[-1] != " " and toxic[e] > 1.2 * most.get(e, 0)}
    return words, stems


class ToxicityModel:
    """Learned from ``labelled`` (text, toxic): at most ``sample`` rows are used, of which
    a third (by a hash of the text) is held back from the lexicon to fit the logistic."""

    def __init__(self, labelled: DataFrame, lexicon: int = LEXICON):
        ship(labelled.sparkSession)
        part = F.pmod(F.xxhash64("text"), F.lit(3))
        rows = labelled.select("text", (F.col("toxic") == 1).alias("toxic"), part.alias("part"))
        learn, fit = rows.where("part < 2"), rows.where("part = 2")
        sizes = dict(learn.groupBy("toxic").count().collect())
        n_clean, n_toxic = sizes.get(False, 0), sizes.get(True, 0)
        least = max(3, n_toxic // 80)
        counts = learn.select("text", "toxic").mapInArrow(lean(_entry_counts), "entry string, clean long, toxic long")
        counts = counts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
        top = counts.where((F.col("toxic") >= least) & (odds >= 20)).orderBy(F.desc("toxic"), "entry").limit(lexicon)
        self.words, self.stems = chosen(top.collect(), n_clean, n_toxic)
        model = (self.words, self.stems)
        seen = fit.select("text", "toxic").mapInArrow(lean(_fit_rows(*model)), "a double, b double, c double, toxic boolean").toPandas()
        self.coefficients = logistic(seen[["a", "b", "c"]].to_numpy(float), seen["toxic"].to_numpy(float))

    def scored(self, docs: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
        """``docs`` with two more columns of these names (own ones of the names are replaced)."""
        kept = docs.drop(score, predicted)
        schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
        return kept.mapInArrow(lean(_scored(self.words, self.stems, self.coefficients, [score, predicted])), schema)


def _fit_rows(words, stems):
    def run(batches):
        scorer = Scorer(words, stems)
        for batch in batches:
            f = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in f], pa.float64()) for i in range(3)), batch.column(1)], ["a", "b", "c", "toxic"])

    return run


def _scored(words, stems, coefficients, names):
    def run(batches):
        scorer = Scorer(words, stems)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]).reshape(-1, 3)
            score = probability(x, coefficients)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*batch.schema.names, *names]
            )

    return run


def probability(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ coefficients[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (constant first) by Newton's method; a slight ridge keeps separable
    samples finite. Without both classes, what weight there is counts as it stands."""
    if not len(y) or y.min() == y.max():
        return np.array([-4.0, 1.0, 0.5, 0.5])
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1]) * len(y) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold, chosen
    by a hash of doc_id. The sample's ids are few enough to be sent to all tasks."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2)).select("doc_id", "toxic")
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A score depends on the text alone. Null and empty texts have the score of no hits.
    Rows that repeat a doc_id each give a row, a null doc_id is not held out, an empty
    table gives no rows, and without labels of both classes a text with no learned term
    scores near 0. Columns other than doc_id and text are not read.
    """
    model = ToxicityModel(training_rows(docs, labels, sample))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    return model.scored(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )
