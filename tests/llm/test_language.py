"""op4: profiles and distances against a plain version, and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from feedlift.llm.language import RANKS, UNKNOWN, Profiles, counts, identify, learn, op4_language, ranked

from .conftest import ROWS


def plain_counts(text):
    found = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f"_{word}_"
            found.update(word)
            found.update(padded[i : i + 2] for i in range(len(padded) - 1))
            found.update(padded[i : i + 3] for i in range(len(padded) - 2))
            word = ""
    return found


@pytest.mark.parametrize("text", ["", "a", "ab  a!b", "Été 1 été", "日本語 x", "no\nno no", "İ"])
def test_counts(text):
    codes, found = counts(text)
    assert sorted(found.tolist()) == sorted(plain_counts(text).values())
    assert len(set(codes.tolist())) == len(codes)


def test_distance_is_out_of_place():
    profiles = Profiles({"x": [5, 6, 7], "y": [7, 6, 5]})
    got = profiles.distances(np.array([5, 6, 9]))
    assert got.tolist() == pytest.approx([(0 + 0 + RANKS) / (3 * RANKS), (2 + 0 + RANKS) / (3 * RANKS)])


def test_ties_are_ranked_by_code_and_named_by_name():
    assert ranked(np.array([9, 3, 5]), np.array([1, 1, 2])).tolist() == [5, 3, 9]
    assert Profiles({"b": [1], "a": [1]}).predict("x")[0] == "a"


def test_held_out_accuracy(spark):
    rows = op4_language(spark, SMALL.replace("0.001", "0.01")).collect()
    langs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").collect()
    langs = {r.doc_id: r.lang for r in langs}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and held
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_odd_documents(odd):
    profiles = learn(odd)
    assert profiles.languages == ["de", "en", "fr"]
    rows = identify(odd, profiles).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in (*profiles.languages, UNKNOWN)
    unknown = sorted((r.doc_id for r in rows if r.lang_pred == UNKNOWN), key=repr)
    want = [d for d, t, *_ in ROWS if not any(c.isalpha() for c in t or "")]
    assert unknown == sorted(want, key=repr)


def test_a_bounded_sample(spark, odd):
    assert learn(odd, most=0).languages == []


def test_nothing(nothing, odd):
    empty = learn(nothing)
    assert identify(nothing, empty).isEmpty()
    assert {r.lang_pred for r in identify(odd, empty).collect()} == {UNKNOWN}
