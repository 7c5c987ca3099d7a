"""Packing's encoder segments a word once, whatever marks and line ends follow it."""

import random

import pytest

from siftline.llm import tokens
from siftline.llm.queries import tokenizer_path
from siftline.llm.tokens import SpacedIds, load, packed

PATH = tokenizer_path("byte_bpe_50k.json")


class Watched:
    def __init__(self, path):
        self.inner, self.asked = load(path), []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **more):
        self.asked += texts
        return self.inner.encode_batch_fast(texts, **more)


def test_words_are_segmented_once(monkeypatch):
    made = []
    monkeypatch.setattr(tokens, "load", lambda path: made.append(Watched(path)) or made[-1])
    encode = SpacedIds(PATH)
    (watched,) = made
    encode(["a lorem ipsum dolor", "Sit", "amet"])
    watched.asked.clear()
    texts = ["a ipsum, lorem. dolor!\nSit ipsum;\namet, ipsum?!"]
    assert encode(texts) == packed(load(PATH), texts)
    asked = " ".join(watched.asked)
    assert not any(word in asked for word in ("lorem", "ipsum", "dolor", "Sit", "amet"))


ALPHABET = [*"   \n\ta1.,²_é'", "Bé", "word", "Über", "!!", "'s", "<|endoftext|>", "<|", "|>", "  ", "\r\n", "\x1c", "　", "日本", "Ёж", "😀"]


@pytest.mark.parametrize("limit", [tokens.LIMIT, 20])
def test_ids_are_the_librarys(limit):
    rng, encode, library = random.Random(5), SpacedIds(PATH), load(PATH)
    encode.spaced.limit = encode.first.limit = limit
    for _ in range(100):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(20)]
        assert encode(texts) == packed(library, texts)
    assert encode([]) == []


def test_a_special_string_across_parts(tmp_path):
    library = load(PATH)
    assert tokens.parts_finely(library)
    library.add_special_tokens([".\nThe"])
    library.save(str(tmp_path / "file.json"))
    assert not tokens.parts_finely(library)
    texts = ["one two.\nThere end.\nThe end", "two.\nThe", "x two. end.\nA"]
    assert SpacedIds(str(tmp_path / "file.json"))(texts) == packed(library, texts)
