"""op6: exact round trip of ids, full windows, and the encoder against the tokenizer."""

import random

import numpy as np
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from feedlift.llm.encoding import PRE_TOKEN, encoder, tokenizer_path
from feedlift.llm.packing import CAPACITY, divide, op6_packing, pack, windows_of

from .conftest import ROWS, prose, table

TOKENIZER = Tokenizer.from_file(tokenizer_path())
PARTS = ["a", " b", " ", "  ", "\n", " \n", "\t", "'re", "don't", "12", ".", " the", "é", "日本", "\U0001f600", "x,", "<|endoftext|>", " "]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_the_pattern_is_the_vocabularys_own():
    import public_tokenizers

    assert PRE_TOKEN.pattern == public_tokenizers.PATTERN


def test_encoder():
    pick = random.Random(1)
    own = encoder(tokenizer_path())
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randrange(40))) for _ in range(1500)]
    for text in [*texts, *(r[1] or "" for r in ROWS)]:
        assert own.encode(text).tolist() == ids(text)


@pytest.mark.parametrize("windows", [1, 2, 7, 40])
def test_differencing_divides_evenly(windows):
    pick = random.Random(windows)
    sizes = [pick.randrange(1, 300) for _ in range(200)]
    found = divide(sizes, windows)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert len(sums) == windows and max(sums) - min(sums) <= max(sizes) / 4


def test_differencing_of_known_numbers():
    """Larger differences first: 8 7 6 5 4 in two come to 16 and 14."""
    sums = sorted(sum((8, 7, 6, 5, 4)[i] for i in w) for w in divide([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]
    assert divide([], 3) == []


def test_one_window_more_where_capacity_is_exceeded():
    assert len(windows_of([600, 600, 600], 1024)) == 3
    assert windows_of([]) == []


def check(docs, rows, most_padding):
    out = pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, got))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    pieces = sorted((x, part) for doc in by_doc.values() for x, part in doc)
    want = [(d, ids(t) + [0]) for d, t in rows]
    # Documents of one id and length come together: each piece is a part of one of them.
    total = sum(len(x) for _, x in want)
    assert sum(len(part) for _, part in pieces) == total
    for d, whole in want:
        found = by_doc[d, len(whole)]
        same = [x for e, x in want if e == d and len(x) == len(whole)]
        assert sum(len(p) for _, p in found) == sum(map(len, same))
        assert all(any(x[s : s + len(p)] == p for x in same) for s, p in found)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    rounding = CAPACITY * docs.rdd.getNumPartitions()
    assert len(by_sequence) * CAPACITY <= total * (1 + most_padding) + rounding


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], 0.01)
    assert op6_packing(spark, SMALL).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]


def test_odd_documents(odd):
    check(odd, [r[:2] for r in ROWS], 0.05)


def test_many_equal_documents(spark):
    rows = [(1, prose(1, 90))] * 3000
    check(table(spark, rows).repartition(2), rows, 0.02)


def test_no_documents(nothing):
    assert pack(nothing).isEmpty()
