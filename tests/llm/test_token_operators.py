"""Tokens, packing, codes, neighbours and the Jaccard join: against libraries and brute force."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import ann, codes, jaccard_join, packing, pieces, tokens

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string"
TEXTS = ["Hello, wide world. " * 60, "", None, " two  spaces\n\nand lines", "l'été qu'il don't", "▁mark ▁ <|endoftext|> |", "a" * 3000, "漢字 1234 ½", "tab\there \x1c x", "Hello, wide world. " * 60]
words = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "'s", "é", "▁", "|", ".", "12", "漢", "\x1c", "　"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], DOCS)


def expected(file, end):
    t = tokens.load(P.path(file))
    return [np.array(e.ids + [end], "<u4") for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_chunk_tables_equal_the_libraries(texts):
    for kind, file in (("spaced", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")):
        want = tokens.load_once(P.path(file)).encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(kind, P.path(file))(texts)] == [e.ids for e in want]
    coder = tokens.encoder("piece", P.path("piece_bpe_32k.model"))
    assert [i for i, _ in coder(texts)] == coder.library.encode(texts)


def test_packing(docs):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    want = expected("byte_bpe_50k.json", 2)
    for i, ids in enumerate(want):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == packing.piece_bounds(len(ids), 1024)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]] and sum(n for _, n in b) <= 1024
    assert packing.pack(docs.limit(0), path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 4))
def test_best_fit_never_overfills(lengths, most):
    bins, used = packing.BestFit(20, most), {}
    for n in lengths:
        at, offset = bins.place(n)
        assert offset == used.get(at, 0)
        used[at] = offset + n
        assert used[at] <= 20 and bins.open <= most and bins.open == sum(map(len, bins.bins))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1200))
def test_levels(ids):
    levels = codes.Levels(codes.encode_levels(np.array(ids, np.uint32)))
    assert levels.all().tolist() == ids and [levels.at(i) for i in range(0, len(ids), 37)] == ids[::37]


def test_id_files(spark, docs, tmp_path):
    want = expected("word_bpe_49k.json", 1)
    target = codes.write_ids(docs, str(tmp_path / "ids"), P.path("word_bpe_49k.json"), segment=50)
    starts = np.cumsum([0, *map(len, want)])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in codes.read_documents(spark, target).collect()}
    assert got == {i: (starts[i], len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(want)}
    flat = np.concatenate(want)
    at = [0, len(flat) // 2, len(flat) - 1]
    assert {r.position: r.id for r in codes.tokens_at(spark, target, at).collect()} == {p: flat[p] for p in at}


def test_sentencepiece(docs):
    library = tokens.encoder("piece", P.path("piece_bpe_32k.model")).library
    for r in pieces.encode_decode(docs, P.path("piece_bpe_32k.model"), keep=True).collect():
        ids = library.encode(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, library.decode(ids))


def brute(texts):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    return [len(s) for s in sets], comp


def test_jaccard_components(spark):
    random = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in random.integers(0, 400, 60)) for _ in range(6)]
    texts = [None, "", " \n ", "one two", "One  two", "two one"]
    for b in base:
        for _ in range(9):
            w = b.split()
            for at in random.integers(0, 60, int(random.integers(0, 3))):
                w[at] = f"x{random.integers(0, 9)}"
            texts.append(" ".join(w))
    n, comp = brute(texts)
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "one two", "en", "s")], DOCS)
    for few in (64, 0):  # as it comes, and with recursion to the last level
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, few=few).collect()}
        assert got.pop(None) == (1, None)
        assert got == {i: (n[i], comp[i]) for i in range(len(texts))}


def test_neighbours(spark):
    x = np.random.default_rng(3).standard_normal((300, 16))
    x[7] = x[3]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == np.lexsort((np.arange(300), -s))[:5].tolist()
    assert set(got) == set(range(0, 300, 50))
