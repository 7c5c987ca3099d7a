r"""Chat formatting whose output parses back to its source.

The grammar of a conversation is a sequence of turns:

    turn    = "### " role ":" NL  body NL "</turn>" NL
    role    = characters other than backslash, colon and NL, or those written \\ \: \n
    body    = text in which each "</turn>" and "### " has a backslash (or more) before it

The parser takes one backslash off each escaped string and refuses an unescaped one. A
turn is rendered as it is, reparsed and compared with its source; what comes back different
is escaped, role or text, and the turn is rendered again until it comes back identical.
Turns are prefix-free, so a conversation's text is its turns' texts in order. The output is
a row per turn: conversations of any length are written and read back as a stream.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import ship

END = "\n</turn>\n"
CONTROL = re.compile(r"(\\*)(</turn>|### )")
HEADER = re.compile(r"### ((?:[^\\:\n]|\\[\\:n])*):\n")
ROLE = re.compile(r"\\(.)", re.S)


class Unparsable(ValueError):
    pass


def unescape(body: str) -> str:
    def one(m):
        if not m[1]:
            raise Unparsable(m[0])
        return m[0][1:]

    return CONTROL.sub(one, body)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\n")


class Parser:
    """Deterministic, incremental: feed() returns the turns that are complete."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> list[tuple[str, str]]:
        self.rest += text
        turns, at = [], 0
        while True:
            head = HEADER.match(self.rest, at)
            stop = self.rest.find(END, head.end()) if head else -1
            if stop < 0:
                break
            role = ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], head[1])
            turns.append((role, unescape(self.rest[head.end() : stop])))
            at = stop + len(END)
        self.rest = self.rest[at:]
        return turns

    def end(self) -> None:
        if self.rest:
            raise Unparsable(self.rest[:80])


def parse(text: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = parser.feed(text)
    parser.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text and where its body begins and ends there."""
    r, t = role, text
    for _ in range(3):
        shown = f"### {r}:\n{t}{END}"
        try:
            back = parse(shown)
        except Unparsable:
            back = []
        if back == [(role, text)]:
            return shown, len(r) + 6, len(r) + 6 + len(t)
        # escape only what conflicts: the role if it can't be read alone, else the text
        try:
            role_reads = parse(f"### {r}:\n{END}") == [(role, "")]
        except Unparsable:
            role_reads = False
        if not role_reads:
            r = escape_role(role)
        else:
            t = escape(text)
    raise Unparsable(shown[:80])


def _rendered(batches):
    for batch in batches:
        out, begin, end = [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            shown, a, b = render(role, text)
            out.append(shown)
            begin.append(a if role == "assistant" else None)
            end.append(b if role == "assistant" else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
            ["conv_id", "turn", "formatted", "loss_start", "loss_end"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, formatted, loss_start, loss_end: a conversation's text is its
    ``formatted`` in order of turn (equal turns: of formatted); the loss mask covers the
    code points from loss_start to loss_end of assistant turns. Null roles and texts count
    as empty, a null turn comes first, and rows with a null conv_id are one conversation.
    Other columns are not read."""
    ship(conversations.sparkSession)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text)
    return rows.mapInArrow(_rendered, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


class Readback:
    """Digests of one conversation, from its formatted stream."""

    def __init__(self):
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted, start, end):
        self.chars += len(formatted)
        for role, text in self.parser.feed(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(formatted[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self, conv):
        self.parser.end()
        return {
            "conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches):
    schema = pa.schema([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in READ.split(", ")])
    now, conv, begun = None, None, False
    for batch in batches:
        rows = []
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
        for c, formatted, start, end in zip(*columns):
            if not begun or c != conv:
                if begun:
                    rows.append(now.row(conv))
                now, conv, begun = Readback(), c, True
            now.add(formatted, start, end)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if begun:
        yield pa.RecordBatch.from_pylist([now.row(conv)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from format_turns()'s output: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Conversations are streamed in
    order; none is held in memory."""
    ship(formatted.sparkSession)
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(_read, READ)
