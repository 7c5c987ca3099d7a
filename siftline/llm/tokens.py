"""Ids of whole texts through tables of distinct chunks.

Where no token can cross a white-space mark, a text's ids are its chunks' ids in order.
Each distinct chunk is segmented once by the public library and kept in a table that
lives as long as the Python worker; a text is then a join of its chunks by position.
The table is emptied before it would pass LIMIT entries (about 250 MB) or LIMIT_CHARS
characters: a chunk is segmented once for each time that the table is filled. Where chunks
are made of parts, one group's parts may come on top.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftline.llm.common import kept

LIMIT = 1_200_000
LIMIT_CHARS = 24_000_000
#: before a single space between two characters that are no white space
CUT = re.compile(r"(?<=\S)(?= \S)")
#: a text without these, and without white space at its ends, can be cut at each of its spaces
TWO = re.compile(r"\s\s")
#: letters in every version of Unicode, and ASCII's marks but the apostrophe
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ʯЁА-яё]+", r"[!-&(-/:-@\[-`{-~]+"
WORD = re.compile(LETTERS)
#: a word, its marks, and a line end with the next line's word and marks
FINE = re.compile(rf"({LETTERS})({MARKS})?(?:(\n)({LETTERS})({MARKS})?)?")
RUN = re.compile(r" +[^ ]*")


class ChunkTable(dict):
    """chunk -> what ``segment`` makes of it; fill() segments the missing ones together.

    segment() takes distinct chunks and returns a dict of them. The libraries take about
    five times as long for a chunk alone as for one in a long text, so chunks are
    segmented in lines and the lines' ids cut apart where chunks begin.
    """

    def __init__(self, segment, limit: int = LIMIT):
        super().__init__()
        self.segment, self.limit, self.chars = segment, limit, 0

    def fill(self, chunk_lists) -> None:
        """The table holds at most its limits and one group's chunks, which need be there
        together."""
        # set.difference() would go through all of a table that is no plain dict
        need = list(filterfalse(self.__contains__, set().union(*chunk_lists)))
        chars = sum(map(len, need))
        if self and need and (len(self) + len(need) > self.limit or self.chars + chars > LIMIT_CHARS):
            self.clear()
            need, self.chars = list(set().union(*chunk_lists)), 0
            chars = sum(map(len, need))
        if need:
            self.chars += chars
            self.update(self.segment(need))


def load(path: str):
    """A tokenizers file as it comes, one thread: special strings in a text are their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def load_once(path: str):
    return load(path)


def packed(tokenizer, texts: list[str]) -> list[bytes]:
    """Ids as little-endian unsigned 32-bit integers."""
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def lines(chunks: list, most: int = 256) -> list[list]:
    return [chunks[i : i + most] for i in range(0, len(chunks), most)]


def parts_finely(tokenizer) -> bool:
    """Whether the file parts texts where FINE does and no special string crosses that."""
    if tokenizer.pre_tokenizer is None or tokenizer.normalizer is not None or tokenizer.token_to_id("Ċ") is None:
        return False
    parted = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(" aBé.,\nCdÉ?!")]
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    crosses = re.compile(rf"(?:{LETTERS})?(?:{MARKS})?(?:\n(?:{LETTERS})?(?:{MARKS})?)?")
    return parted == [(0, 4), (4, 6), (6, 7), (7, 10), (10, 12)] and not any(map(crosses.fullmatch, special))


class SpacedIds:
    """Byte-level BPE whose pattern ties one space to what follows it: cut before each
    single space between two other characters.

    Texts are cut, and a group's distinct chunks found, by Arrow's kernels. A chunk that the
    table lacks is made of its parts where the pattern would part it (FINE), so that a
    word is segmented once whatever marks and lines follow it.
    """

    def __init__(self, path: str):
        tokenizer = load(path)
        begins = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(tokenizer.get_vocab_size())])
        fine = parts_finely(tokenizer)
        line_end = tokenizer.token_to_id("Ċ")

        def segment_first(chunks):
            out = {}
            plain = [c for c in chunks if fine and WORD.fullmatch(c)]
            for some in lines(lines(plain), 8):
                for line, e in zip(some, tokenizer.encode_batch_fast(["\n".join(x) for x in some], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    at = np.flatnonzero(ids == line_end) * 4
                    if len(at) == len(line) - 1:
                        ids = ids.tobytes()
                        out.update(zip(line, [ids[a:b] for a, b in zip([0, *(at + 4)], [*at, len(ids)])]))
            rest = [c for c in chunks if c not in out]
            out.update(zip(rest, packed(tokenizer, rest)))
            return out

        def segment(chunks):
            parts, whole = {}, chunks
            if fine:
                found = [m if m and m.lastindex > 1 else None for m in map(FINE.fullmatch, chunks)]
                parts = {c: m.groups("") for c, m in zip(chunks, found) if m}
                words = dict.fromkeys(p[0] for p in parts.values())
                have = {w: self.spaced[w] for w in words if w in self.spaced}
                whole = list(dict.fromkeys([c for c, m in zip(chunks, found) if not m] + [w for w in words if w not in have]))
            plain = [c for c in whole if c and c == c.strip() and " " not in c]
            out = {}
            # the library's encodings take far more memory than their ids: a few lines at a time
            for some in lines(lines(plain), 8):
                for line, e in zip(some, tokenizer.encode_batch_fast([" " + " ".join(x) for x in some], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    at = np.flatnonzero(begins[ids]) * 4
                    if len(at) == len(line):
                        ids = ids.tobytes()
                        out.update(zip(line, [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)])]))
            rest = [c for c in whole if c not in out]
            out.update(zip(rest, packed(tokenizer, [" " + c for c in rest])))
            if parts:
                self.spaced.chars += sum(map(len, out)) - sum(len(c) for c in chunks if c in out)
                self.first.fill([p[1:] for p in parts.values()])
                first = self.first
                for c, (word, marks, end, next_word, next_marks) in parts.items():
                    ids = (out[word] if word in out else have[word]) + first[marks]
                    out[c] = ids + first[end] + first[next_word] + first[next_marks] if end else ids
            return out

        self.first = ChunkTable(segment_first, LIMIT // 8)
        self.spaced = ChunkTable(segment)

    def __call__(self, texts: list[str]) -> list[bytes]:
        starts, plain, rests, other, chunks, counts = [], [], [], [], [], []
        for i, text in enumerate(texts):
            if TWO.search(text) or text[:1].isspace() or text[-1:].isspace():
                parts = CUT.split(text)
                starts.append(parts[0])
                other.append(i)
                counts.append(len(parts) - 1)
                chunks += [p[1:] for p in parts[1:]]
            else:  # can be cut at each of its spaces
                start, space, rest = text.partition(" ")
                starts.append(start)
                plain.append(i)
                rests.append(rest if space else None)
        # before the table of starts gets parts of other chunks
        self.first.fill([starts])
        starts = [self.first[s] for s in starts]
        cuts = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        counts = pc.fill_null(pc.list_value_length(cuts), 0).to_pylist() + counts
        coded = pa.concat_arrays([cuts.flatten(), pa.array(chunks, pa.large_string())]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # each chunk is looked up once; only what the table lacks then is looked up again
        found = list(map(self.spaced.get, distinct))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        self.spaced.fill([[distinct[i] for i in lacking]])
        for i in lacking:
            found[i] = self.spaced[distinct[i]]
        # all ids of the group, one chunk after another
        _, offsets, data = pa.array(found, pa.large_binary()).take(coded.indices).buffers()
        bounds = np.cumsum([0, *counts])
        if bounds[-1]:
            bounds, data = np.frombuffer(offsets, np.int64)[bounds], memoryview(data or b"")
        out = [b""] * len(texts)
        for i, a, b in zip(plain + other, bounds, bounds[1:]):
            out[i] = b"".join((starts[i], data[a:b])) if b > a else starts[i]
        return out


class WordIds:
    """BPE with word ends that drops white space: cut at spaces and line ends."""

    def __init__(self, path: str):
        tokenizer = load(path)
        bar = tokenizer.token_to_id("|</w>").to_bytes(4, "little")

        def segment(chunks):
            plain = [c for c in chunks if c and "|" not in c]
            out = {}
            for line, ids in zip(lines(plain), packed(tokenizer, [" | ".join(x) for x in lines(plain)])):
                ids = np.frombuffer(ids, "<u4")
                at = np.flatnonzero(ids == int.from_bytes(bar, "little")) * 4
                if len(at) == len(line) - 1:
                    ids = ids.tobytes()
                    out.update(zip(line, [ids[a:b] for a, b in zip([0, *(at + 4)], [*at, len(ids)])]))
            rest = [c for c in chunks if c not in out]
            out.update(zip(rest, packed(tokenizer, rest)))
            return out

        self.table = ChunkTable(segment)

    def __call__(self, texts: list[str]) -> list[bytes]:
        cuts = [t.replace("\n", " ").split(" ") for t in texts]
        self.table.fill(cuts)
        ids = self.table.__getitem__
        return [b"".join(map(ids, c)) for c in cuts]


class PieceIds:
    """sentencepiece BPE with a leading mark: cut before each run of marks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = [library.piece_to_id("▁")]
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this model cross white-space marks")
        begins = np.array([p.startswith("▁") for p in pieces])

        def segment(chunks):
            # the library adds a text's first mark itself, but nothing to an empty text
            plain = [c for c in chunks if len(c) > 1 and c.rfind(" ") == 0]
            out = {}
            for line, ids in zip(lines(plain), library.encode(["".join(x)[1:] for x in lines(plain)], num_threads=1)):
                at = np.flatnonzero(begins[ids]).tolist()
                if len(at) == len(line):
                    out.update(zip(line, [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)])]))
            rest = [c for c in chunks if c not in out]
            if rest:
                out.update((c, ids or mark) for c, ids in zip(rest, library.encode([c[1:] for c in rest], num_threads=1)))
            return {c: (ids, ",".join(map(str, ids))) for c, ids in out.items()}

        self.table = ChunkTable(segment, LIMIT // 2)

    def __call__(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text its ids and the same ids in decimal, joined by commas."""
        cuts = []
        for text in texts:
            text = text.replace("▁", " ")
            cuts.append(RUN.findall(" " + text) if text else [])
        self.table.fill(cuts)
        out = []
        for cut in cuts:
            parts = [self.table[c] for c in cut]
            out.append(([i for ids, _ in parts for i in ids], ",".join([s for _, s in parts])))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


KINDS = {"spaced": SpacedIds, "word": WordIds, "piece": PieceIds}


def tables(kind: str, path: str, limit: int) -> tuple:
    """The owner of an encoder in its worker's cache."""
    return "tokens", kind, path, limit


def encoder(kind: str, path: str, limit: int = LIMIT):
    """One encoder per Python worker and file, until another operator runs there; its
    tables hold ``limit`` entries at most."""
    cache = kept(tables(kind, path, limit))
    if "encoder" not in cache:
        cache["encoder"] = made = KINDS[kind](path)
        for table in vars(made).values():
            if isinstance(table, ChunkTable):
                table.limit = min(table.limit, limit)
    return cache["encoder"]


def groups(texts: list[str], most: int = 2_000_000):
    """Consecutive texts of about ``most`` characters together."""
    part, chars = [], 0
    for text in texts:
        part.append(text)
        chars += len(text)
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part
