import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


@given(st.integers(1, 5000))
def test_shares(n):
    got = packing.shares(n)
    assert sum(got) == n and all(0 < x <= 1024 for x in got)
    assert sum(x < 32 for x in got) <= 1


@given(st.lists(st.integers(1, 1024), max_size=300))
def test_bins(lengths):
    bins, closed = packing.HarmonicBins(1024, 0), []
    for i, n in enumerate(lengths):
        closed += bins.add((n, i))
    full = len(closed)
    closed += bins.flush()
    assert sorted(p[1] for _, b in closed for p in b) == list(range(len(lengths)))
    assert all(sum(p[0] for p in b) <= 1024 for _, b in closed) and len({s for s, _ in closed}) == len(closed)
    assert all(len(b) == 1024 // b[0][0] and len({1024 // p[0] for p in b}) == 1 for _, b in closed[:full])


@given(st.text(max_size=200))
def test_ids_are_the_librarys(text):
    bpe = getattr(test_ids_are_the_librarys, "bpe", None) or packing.ByteBpe(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    test_ids_are_the_librarys.bpe = bpe
    assert bpe.encode(text) == bpe.exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "it's we'll  two  spaces\n\n x", "é ü ñ ß ¿qué? «oui» “q” – …", "\x1c\x85\xa0 \u2003x", "١٢٣ 中文 🎉", ""])
def test_ids_of_odd_texts(text):
    bpe = packing.ByteBpe(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert bpe.encode(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def check(got, texts):
    """texts: list of (id, text); repeated rows are told apart by their pieces' order."""
    exact = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, len(ids := exact.encode(t or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for d, t in texts)
    for s, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces.offset.tolist() == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() <= 1024
        assert set(pieces.padded_length) == {packing.padded(int(pieces.length.sum()))}
    assert got.length.sum() == sum(w[2] for w in want)
    if "ids" in got:
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())


def test_pack(spark, sf, edge_docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(df, with_ids=True).toPandas()
    texts = [(r.doc_id, r.text) for r in df.collect()]
    check(got, texts)
    exact, by_doc = Tokenizer.from_file(PATH), dict(texts)
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        assert [x for p in pieces.ids for x in p] == [*exact.encode(by_doc[d], add_special_tokens=False).ids, 0]
        assert set(pieces.doc_tokens) == {pieces.length.sum()}
    used, held = got.length.sum(), got.groupby("sequence_id").padded_length.first().sum()
    assert held < 1.02 * used
    edge = packing.pack(edge_docs, with_ids=True).toPandas()
    check(edge, [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=1000)
