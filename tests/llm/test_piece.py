import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from rowloom.llm import piece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return piece.load(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehinost  \n▁é中0", max_size=80))
def test_same_as_the_library(text):
    ids = piece.load(MODEL).encode(text)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids == library.encode(text) and piece.load(MODEL).decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a", "a" * 20_000, " " * 3_000, "the" * 5_000, "中文" * 3_000, "tion\n\n\tx", "\x00"])
def test_long_and_odd_texts(pieces, library, text):
    ids = pieces.encode(text)
    assert ids == library.encode(text) and pieces.decode(ids) == library.decode(ids)


def test_backtracking_finds_what_merging_finds(pieces):
    for text in ("▁unbelievably", "▁internationalization", "aaaaaaaaab", "▁▁▁▁▁x", "hehehethththth"):
        assert pieces.pieces(text) == pieces.merge(text)


def test_edges(spark, edges, nothing, library):
    got = piece.encode_digests(edges, MODEL).collect()
    assert len(got) == edges.count()
    for r in got:
        ids = library.encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece.encode_digests(nothing, MODEL).count() == 0
    full = piece.encode(edges.where("doc_id = 4"), MODEL).first()
    assert full.ids == library.encode("one two three") and full.decoded == "one two three"
