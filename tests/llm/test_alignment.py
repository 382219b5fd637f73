"""Alignment of two vocabularies against dense matrices and the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings, strategies as st

from feedlift.llm import alignment
from feedlift.llm.alignment import (
    Aligner,
    Csr,
    align,
    groups_of,
    link_sums,
    links_of,
    op12_alignment,
    overlaps,
    pair_counts,
)
from feedlift.llm.common import read_table, written
from feedlift.llm.encoding import BYTE_BPE, tokenizer_path
from feedlift.llm.sentencepieces import PIECE_BPE

PATHS = tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)


def dense(matrix):
    out = np.zeros((len(matrix), matrix.width), np.int64)
    out[matrix.rows(), matrix.columns] = matrix.values
    return out


def sparse(array):
    rows, columns = np.nonzero(array)
    matrix = Csr.of_rows(np.bincount(rows, minlength=len(array)), columns, array.shape[1])
    matrix.values = array[rows, columns]
    return matrix


@pytest.mark.parametrize("seed", range(8))
def test_product_and_transpose(seed):
    pick = np.random.default_rng(seed)
    n, m, k = pick.integers(0, 9, 3)
    a, b = (pick.integers(0, 3, size) * pick.integers(0, 2, size) for size in ((n, m), (m, k)))
    assert (dense(sparse(a).times(sparse(b))) == a @ b).all()
    assert (dense(sparse(a).transposed()) == a.T).all()
    product = sparse(a).times(sparse(b))
    for start, end in zip(product.starts, product.starts[1:]):
        assert (np.diff(product.columns[start:end]) > 0).all()


def cut(total, pick):
    ends = sorted({*pick.sample(range(1, total), pick.randint(0, total - 1)), total})
    return np.diff([0, *ends])


@pytest.mark.parametrize("seed", range(20))
def test_groups_end_where_both_end(seed):
    pick = random.Random(seed)
    a, b = cut(30, pick), cut(30, pick)
    shared = overlaps(a, b)
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    both = sorted(set(a_end) & set(b_end))
    a_group, b_group = groups_of(shared)
    assert a_group.tolist() == np.searchsorted(both, a_end).tolist()
    assert b_group.tolist() == np.searchsorted(both, b_end).tolist()
    want = np.array([[g == h for h in b_group] for g in a_group])
    assert (dense(links_of(a_group, b_group)) == want).all()


class Plain:
    """The rules of the alignment, read out of whole texts by the libraries."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        inner = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [byte for byte in range(256) if byte not in inner]
        self.byte = {chr(byte): byte for byte in inner}
        self.byte |= {chr(256 + number): byte for number, byte in enumerate(rest)}

    def b_bytes(self, number):
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def groups(self, text):
        """Lists of ids of either side, group by group; nothing where a text has no tokens."""
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False)
        pairs = [bytes(map(self.byte.__getitem__, token)) for token in a.tokens]
        b_ids = self.b.encode(text)
        others = [self.b_bytes(number) for number in b_ids]
        if not b"".join(pairs) == b"".join(others) == (" " + text).encode():
            return []
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (pairs, others))
        out, i, k = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            j, m = a_ends.index(end, i) + 1, b_ends.index(end, k) + 1
            out.append((a.ids[i:j], b_ids[k:m]))
            i, k = j, m
        return out

    @staticmethod
    def text_of(groups):
        return ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)

    def rows(self, docs):
        found = [(doc_id, self.groups(text)) for doc_id, text in docs]
        held = Counter()
        for _, groups in found:
            held.update({(a, b) for one, other in groups for a in one for b in other})
        best = defaultdict(int)
        for (a, _), n in held.items():
            best[a] = max(best[a], n)
        for doc_id, groups in found:
            links = [(a, b) for one, other in groups for a in one for b in other]
            text = self.text_of(groups)
            yield (
                doc_id,
                sum(len(one) for one, _ in groups),
                sum(len(other) for _, other in groups),
                len(groups),
                len(links),
                sum(held[link] == best[link[0]] for link in links),
                sum(held[link] for link in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )


PLAIN = Plain()
STRANGE = ["", "a▁b", "Hello, wörld  x", " a", "a ", "\n\n\tx \x1c y", "日本語 \U0001f600 é",
           "<|endoftext|> <s> </s>", "don't 123's", "x" * 300, "　 ﬁ", "\x00"]


def aligned(aligner, texts):
    sizes, groups, pairs = aligner.align(texts)
    return sizes.tolist(), [one.decode() for one in groups], pairs


Aligner.shared = Aligner(*PATHS)


@pytest.mark.parametrize("text", STRANGE)
def test_strange_texts(text):
    sizes, groups, _ = aligned(Aligner.shared, [text, "ok", text])
    want = PLAIN.text_of(PLAIN.groups(text))
    assert groups == [want, PLAIN.text_of(PLAIN.groups("ok")), want]
    assert sizes[0][2] == len(PLAIN.groups(text))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n\t'é▁日.,\x1c0\x85", max_size=25), max_size=5))
def test_any_texts(texts):
    _, groups, _ = aligned(Aligner.shared, texts)
    assert groups == [PLAIN.text_of(PLAIN.groups(text)) for text in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_PARTS", 3)
    aligner = Aligner(*PATHS)
    texts = ["one two three four", "five six one", "x" * 100 + " one"]
    for _ in range(3):
        assert aligned(aligner, texts)[1] == [PLAIN.text_of(PLAIN.groups(t)) for t in texts]


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_query_equals_plain(spark):
    found = op12_alignment(spark, SMALL)
    assert found.columns == COLUMNS
    assert all(kind in ("bigint", "string") for _, kind in found.dtypes)
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, found.collect())) == sorted(PLAIN.rows(docs))


def test_odd_documents(spark, odd):
    got = align(odd).collect()
    docs = [(row.doc_id, row.text) for row in odd.select("doc_id", "text").collect()]
    want = [(doc_id, PLAIN.text_of(PLAIN.groups(text))) for doc_id, text in docs]
    assert sorted(((r.doc_id, r.groups) for r in got), key=repr) == sorted(want, key=repr)
    assert len({row.row for row in got}) == len(docs)


def test_any_share_of_pairs_may_be_broadcast(spark, odd):
    rows = written(align(odd), "aligned")
    counts = written(pair_counts(rows, Aligner.shared.b_count), "counts")
    docs = [(row.doc_id, row.text) for row in odd.select("doc_id", "text").collect()]
    want = sorted((row[1:7] for row in PLAIN.rows(docs)), key=repr)
    names = COLUMNS[1:7]
    for most in (0, 40, 1000):
        got = rows.join(link_sums(rows, counts, most), "row", "left").na.fill(0).collect()
        assert sorted((tuple(r[name] for name in names) for r in got), key=repr) == want


def test_empty_table(spark, nothing):
    rows = align(nothing)
    assert rows.count() == 0
    assert link_sums(rows, pair_counts(rows, 32_000)).count() == 0
