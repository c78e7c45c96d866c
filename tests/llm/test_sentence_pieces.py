import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.sentence_pieces import PieceModel, decode, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "Hello   world ▁x \n\n 漢字 ꙮ <s> a  ", "x" * 500, " " * 57 + "a", "ab\0c\0", "▁", "a ▁ b", "----" * 9 + "=====", "\t\t  \r\n", "<0x0A>", "ΑΣ İ", "a" * 33 + " " * 33]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return PieceModel(PATH)


def test_odd_texts_as_the_library(library, own):
    ids, at = own.encode(ODD)
    for text, a, b in zip(ODD, at, at[1:]):
        assert ids[a:b].tolist() == library.encode(text), text
        assert own.decode(ids[a:b].tolist()) == library.decode(library.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" ▁aeinrst-=\n漢ꙮ12"), max_size=60), max_size=5))
def test_any_texts_as_the_library(texts):
    lib, m = test_any_texts_as_the_library.both
    ids, at = m.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == lib.encode(texts)


test_any_texts_as_the_library.both = (sentencepiece.SentencePieceProcessor(model_file=PATH), PieceModel(PATH))


def test_what_is_kept_is_bounded(library):
    m = PieceModel(PATH, keep=3)
    for text in ("one two three four five", "six seven eight", "one two"):
        ids, _ = m.encode([text])
        assert ids.tolist() == library.encode(text)
    assert len(m.known) <= 3 + 5


def test_rows(spark, odd_docs, library):
    rows = [r["text"] for r in odd_docs.collect()]
    got = digests(odd_docs, PATH).collect()
    want = []
    for r, t in zip(odd_docs.collect(), rows):
        ids = library.encode(t or "")
        want.append((r["doc_id"], len((t or "").encode()), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert digests(odd_docs.limit(0), PATH).count() == 0


def test_decode_keeps_other_columns(spark, odd_docs, library):
    coded = encode(odd_docs.where("text is not null"), PATH)
    back = decode(coded, PATH).collect()
    texts = sorted(r["text"] for r in odd_docs.where("text is not null").collect())
    assert sorted(r["text"] for r in back) == texts
    assert back[0].asDict().keys() == {"doc_id", "n_bytes", "text"}
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"], r["text"]) for r in decode(empty, PATH).collect()) == [(1, None), (2, "")]
    assert decode(empty.limit(0), PATH).collect() == []
