"""Special strings in texts: ids as the tokenizers files themselves give them."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm import codes, packing, tokens

P = pytest.importorskip("public_tokenizers")
TEXTS = ["a <|endoftext|> b", "<|startoftext|>x  <|endoftext|>", "plain words"]
words = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "'s", "é", "|", ".", "<|endoftext|>", "<|startoftext|>", "<|end", "\x1c"]), max_size=20).map("".join)


def library(file, texts):
    return [e.ids for e in Tokenizer.from_file(P.path(file)).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_chunks_equal_the_file(texts):
    for kind, file in (("spaced", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(kind, P.path(file))(texts)] == library(file, texts)


def test_packing_and_id_files(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = [ids + [2] for ids in library("byte_bpe_50k.json", TEXTS)]
    assert want[0] == [64, 220, 50256, 275, 2]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: (len(w), crc(w)) for i, w in enumerate(want)}
    want = [ids + [1] for ids in library("word_bpe_49k.json", TEXTS)]
    starts = np.cumsum([0, *map(len, want)])
    target = codes.write_ids(docs, str(tmp_path / "ids"), P.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in codes.read_documents(spark, target).collect()}
    assert got == {i: (starts[i], len(w), crc(w)) for i, w in enumerate(want)}
