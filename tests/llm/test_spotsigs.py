"""op7: signatures, the next document, and near pairs against plain versions."""

import hashlib
import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from feedlift.llm import spotsigs
from feedlift.llm.spotsigs import (
    ANCHORS,
    fingerprints,
    near_pairs,
    op7_spotsigs,
    with_next,
    with_signatures,
)

from .conftest import ROWS, prose, table


def chains(text):
    """What the signatures of a text are hashes of."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    spots, run = [], []
    for word in words:
        if word in ANCHORS:
            run.append(word)
        else:
            spots.append((tuple(run), word))
            run = []
    if run:
        spots.append((tuple(run), ""))
    content = [w for _, w in spots]
    found = {(a, *content[i : i + 3]) for i, (a, _) in enumerate(spots) if a}
    return found or {(a, *content[i : i + 3]) for i, (a, _) in enumerate(spots)}


TEXTS = [r[1] for r in ROWS] + ["the", "the of", "house", "the house", "big house", "the the the", "a b c d the e"]


def test_signatures_are_as_many_as_chains(spark):
    docs = table(spark, enumerate(TEXTS))
    got = {r.doc_id: r.signatures for r in fingerprints(docs).collect()}
    for i, text in enumerate(TEXTS):
        assert len(got[i]) == len(chains(text))
        assert got[i] == sorted(set(got[i]))


def test_likeness_is_that_of_the_chains(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    rows = fingerprints(docs).collect()
    for a, b in zip(rows, rows[1:], strict=False):
        one, two = chains(a.text), chains(b.text)
        mine = len(set(a.signatures) & set(b.signatures)) / len(set(a.signatures) | set(b.signatures))
        assert mine == pytest.approx(len(one & two) / len(one | two))


@pytest.mark.parametrize("run_rows", [3, 41, 4000])
def test_the_query(spark, monkeypatch, run_rows):
    monkeypatch.setattr(spotsigs, "RUN_ROWS", run_rows)
    rows = op7_spotsigs(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    follows = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for doc_id, text in texts.items():
        cut = len(text) // 3
        edited = text[: len(text) - cut] + texts[follows[doc_id]][:cut]
        assert got[doc_id].n_chars == len(text)
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (
            {x[i : i + 8] for i in range(0, len(x), 8)}
            for x in (got[doc_id].fingerprint, got[follows[doc_id]].fingerprint)
        )
        assert got[doc_id].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.35
    assert sum(r.near_next for r in rows) / len(rows) < 0.05


@pytest.mark.parametrize("run_rows", [1, 5, 4000])
def test_next_of_odd_documents(spark, odd, monkeypatch, run_rows):
    """Cyclic by descending id, rows without an id last, those of one id in a fixed order."""
    monkeypatch.setattr(spotsigs, "RUN_ROWS", run_rows)
    rows = fingerprints(odd).select("doc_id", "text_key", "text")
    got = with_next(rows, "doc_id", "text_key").collect()
    order = sorted(
        ((r.doc_id, r.text_key) for r in rows.collect()),
        key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, -(x[1] or 0)),
    )
    want = sorted(zip(order, order[1:] + order[:1], strict=True), key=repr)
    assert sorted((((r.doc_id, r.text_key), (r.next_doc_id, r.next_text_key)) for r in got), key=repr) == want


def test_equal_texts_have_equal_fingerprints(odd):
    rows = fingerprints(odd).groupBy("text").agg(F.count_distinct("signatures").alias("n"))
    assert rows.where("n != 1").isEmpty()


def test_one_document_is_its_own_next(spark):
    one = with_next(fingerprints(table(spark, [(7, "a house")])), "doc_id").collect()
    assert [(r.doc_id, r.next_doc_id) for r in one] == [(7, 7)]


def test_near_pairs(spark):
    pick = random.Random(5)
    sets = []
    for _ in range(12):
        base = pick.sample(range(400), pick.randrange(3, 60))
        for _ in range(5):
            own = set(base)
            for _ in range(pick.randrange(4)):
                own ^= {pick.randrange(400)}
            sets.append(tuple(sorted(own)))
    sets = [(i, list(s)) for i, s in enumerate(sorted(set(sets)))] + [(9999, [])]
    found = near_pairs(spark.createDataFrame(sets, "set_id long, signatures array<int>"))
    got = {(r.u, r.v): round(r.likeness, 9) for r in found.collect()}
    want = {}
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b:
                like = len(set(a) & set(b)) / len(set(a) | set(b))
                if like >= 0.8:
                    want[i, j] = round(like, 9)
    assert got == want and want


def test_no_documents(spark, nothing):
    assert with_next(fingerprints(nothing), "text").isEmpty()


def test_long_text(spark):
    docs = table(spark, [(1, prose(3, 100_000))])
    found = with_signatures(docs, "text", "signatures").first().signatures
    assert len(found) == len(chains(prose(3, 100_000)))
