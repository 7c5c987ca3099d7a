"""Packing's workers hold some texts of a batch at a time, whatever the batch holds."""

import pyarrow as pa

from siftline.llm import packing
from siftline.llm.queries import tokenizer_path
from siftline.llm.tokens import ChunkTable, SpacedIds, load, packed


def test_a_batch_is_encoded_in_slices(monkeypatch):
    texts = [f"word {'many words ' * (i % 7)}{i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    seen, plain = [], packing.groups
    monkeypatch.setattr(packing, "groups", lambda part, *most: seen.append(len(part)) or plain(part, *most))
    out = list(packing._pieces("spaced", tokenizer_path("byte_bpe_50k.json"), 2, 16)(iter([batch])))
    assert sum(seen) == 1000 and max(seen) <= 256
    rows = [r for b in out for r in b.to_pylist()]
    assert sorted({r["doc_id"] for r in rows}) == list(range(1000))
    assert all(r["length"] <= 16 for r in rows)


def test_filling_a_table_does_not_go_through_it():
    class Watched(ChunkTable):
        def __iter__(self):
            raise AssertionError("all of the table was read")

    asked = []
    table = Watched(lambda chunks: asked.extend(chunks) or {c: c.encode() for c in chunks})
    table.fill([["a", "b"], ["b"]])
    table.fill([["b", "c"], ["c"]])
    assert sorted(asked) == ["a", "b", "c"] and len(table) == 3


def test_a_group_whose_chunks_empty_the_table_keeps_what_it_found():
    path = tokenizer_path("byte_bpe_50k.json")
    small, large = SpacedIds(path), SpacedIds(path)
    small.spaced.limit = 5
    for texts in (["one two three four", "five six"], ["zero two seven eight nine ten", "six two  eleven\n twelve"], ["", " two"]):
        assert small(texts) == large(texts) == packed(load(path), texts)
