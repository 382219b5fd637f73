"""Documents of every odd kind, and tables of them."""

import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, and others they might.
CLASHES = "fp hash n score label place text_key gone u v w rank p".split()
NOTICE = "Licensed under the Apache License, Version 2.0."


def prose(seed, words):
    pick = random.Random(seed)
    stems, ends = ("ka", "lo", "mi", "ne", "su", "the", "of"), ("n", "ra", "st", "")
    stock = [stem + end for stem in stems for end in ends]
    out = [pick.choice(stock) for _ in range(words)]
    for at in range(9, words, 10):
        out[at] += "." if at % 20 else ".\n"
    return " ".join(out).replace("\n ", "\n")


ROWS = [
    (1, prose(1, 120), "en", "a", 0),
    (2, prose(2, 60) + " " + NOTICE, "en", "a", None),
    (3, None, "en", "a", 1),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "b", 4),
    (6, prose(6, 30_000), "de", "b", 9),
    (7, prose(1, 120), "en", None, 0),
    (8, prose(2, 60) + " " + NOTICE + " more", "en", "a", 0),
    (8, "another text of that id", "fr", "c", 0),
    (9, prose(9, 80), "fr", "c", 0),
    (9, prose(9, 80), "fr", "c", 0),
    (9, prose(9, 80), "fr", "c", 0),
    (None, prose(1, 120), "en", "a", 0),
    (None, None, None, None, None),
    (11, "x", "en", "a", 1),
    (12, "日本語 \U0001f600 ÉÀ ß", "en", "d", 1),
    (13, "123 456 !!! ###", "en", "d", 1),
]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    docs = spark.createDataFrame(ROWS, FIELDS).repartition(3)
    return docs.selectExpr("*", *(f"'{name}' AS {name}" for name in CLASHES))


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], FIELDS)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], FIELDS)


def same_rows(df, want):
    got = sorted((tuple(row) for row in df.collect()), key=repr)
    assert got == sorted(want, key=repr)
