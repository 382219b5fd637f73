"""op1: phrases against a plain search, notices by their diagonals."""

import re

import pytest
from conftest import SMALL

from feedlift.llm.licenses import NOTICES, PHRASES, scan, templates

from .conftest import ROWS, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def found(spark, docs):
    rows = scan(docs, templates(spark)).collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base) for r in rows), key=repr
    )


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(spark, docs) == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)


def test_odd_documents(spark, odd):
    assert found(spark, odd) == sorted(((d, *plain(t)) for d, t, *_ in ROWS), key=repr)


TEXTS = [
    "MIT LICENSE mit license Mit-License",
    "cc by cc by-nc CC BY",
    "gnu general public licenses",
    "gnu general gnu general public license",
    "Apache License apache license",
    "apache",
    "mit",
]


def test_phrases_in_odd_places(spark):
    rows = list(enumerate(TEXTS))
    assert found(spark, table(spark, rows)) == sorted(((i, *plain(t)) for i, t in rows), key=repr)


@pytest.mark.parametrize("label", NOTICES)
def test_a_notice_with_words_more_and_less(spark, label):
    words = NOTICES[label].split()
    middle = len(words) // 2
    more = [*words[:middle], "hereby", *words[middle:]]
    # A notice of a few words must stand whole.
    texts = [words] + [more] * (len(words) > 5)
    texts += [[*words[: middle - 1], *words[middle:]]] * (len(words) > 8)
    rows = [(i, f"{prose(i, 40)} {' '.join(t).upper()} {prose(i + 9, 40)}") for i, t in enumerate(texts)]
    rows += [(99, prose(99, 3000))]
    got = {r.doc_id: r for r in scan(table(spark, rows), templates(spark)).collect()}
    for i in range(len(texts)):
        assert label in got[i]["all"]
        span = next(s for s in got[i].spans if s.label == label)
        assert span.first == len(WORD.findall(prose(i, 40))) and 0.7 < got[i].score <= 1
    assert got[99]["all"] == [] and got[99].score == 0


def test_no_documents(spark, nothing):
    assert scan(nothing, templates(spark)).isEmpty()
