"""Piece ids against the library, by both kinds of agenda."""

import hashlib
import random

import pytest
from conftest import SMALL
from hypothesis import given, settings, strategies as st

from feedlift.llm.common import read_table
from feedlift.llm.encoding import tokenizer_path
from feedlift.llm.sentencepieces import (
    LONGEST_ROW,
    PIECE_BPE,
    encode_pieces,
    op13_sentencepiece,
    piece_encoder,
)

ENCODER = piece_encoder(tokenizer_path(PIECE_BPE))
STRANGE = ["", " ", "  ", "a ", " a", "▁", "a▁ b", "\n\n x", "\x00", "日本語 \U0001f600", "ÿĀ ﬁ",
           "<s> </s> <unk> <0x41>", "é é", "　  ", "ab" * 300, "a" * 5000]


def plain(texts):
    return ENCODER.library.encode(texts)


@pytest.mark.parametrize("text", STRANGE)
def test_strange_texts(text):
    assert ENCODER.ids(text).tolist() == ENCODER.library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_texts(texts):
    packed, agrees = ENCODER.checked(texts)
    assert all(agrees)
    assert [len(ids) // 4 for ids in packed] == [len(ids) for ids in plain(texts)]
    assert [ENCODER.ids(text).tolist() for text in texts] == plain(texts)


def test_both_agendas_agree():
    pick = random.Random(5)
    words = ["".join(pick.choices("thedonire,. éè日\n0", k=LONGEST_ROW - 2)) for _ in range(400)]
    rows = ENCODER.encode_parts(words)
    assert rows == [ENCODER._one("▁" + word.replace(" ", "▁")) for word in words]


def test_disagreement_is_told():
    encoder = type(ENCODER)(tokenizer_path(PIECE_BPE))
    right = encoder.encode_parts
    encoder.encode_parts = lambda parts: [b"" if p == "wrong" else right([p])[0] for p in parts]
    assert encoder.checked(["all right", "all wrong", "wrong again", "right"])[1] == [
        True, False, False, True,
    ]
    assert encoder.checked(["wrong", "again"])[1] == [False, True]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("feedlift.llm.sentencepieces.MOST_PARTS", 3)
    encoder = type(ENCODER)(tokenizer_path(PIECE_BPE))
    for _ in range(2):
        texts = ["one two three four", "five six one", "x" * 100]
        packed, _ = encoder.checked(texts)
        assert packed == [ENCODER.ids(text).tobytes() for text in texts]


def wanted(rows):
    out = []
    for doc_id, text in rows:
        ids = ENCODER.library.encode(text or "")
        listed = ",".join(map(str, ids)).encode()
        decoded = ENCODER.library.decode(ids).encode()
        out.append((doc_id, len(ids), *(hashlib.sha256(x).hexdigest() for x in (listed, decoded))))
    return sorted(out, key=repr)


def test_query_equals_library(spark):
    got = op13_sentencepiece(spark, SMALL)
    assert got.where("NOT agrees").isEmpty()
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.drop("agrees").collect()), key=repr) == wanted(docs)


def test_odd_documents(spark, odd):
    got = encode_pieces(odd)
    assert got.where("NOT agrees").isEmpty()
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((i, ENCODER.library.encode(t or "")) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == want
    texts = sorted(t.replace("▁", " ") if t else "" for _, t in rows)
    assert sorted(r.decoded for r in got.collect()) == texts


def test_empty_table(spark, nothing):
    assert encode_pieces(nothing).count() == 0


def test_unchecked(spark, odd):
    assert encode_pieces(odd, check=False).where("agrees IS NOT NULL").isEmpty()
