"""Defaults, conversions and what cannot be converted."""

from feedlift.operators.normalize import REQUIRED_WHOLE, flag_unusable, normalize_posts
from feedlift.schema import RAW_TYPES, WIRE_COLUMNS, WIRE_TYPES, ddl

FULL = {
    "id": "a1",
    "title": "t",
    "author": "bo",
    "subreddit": "s",
    "score": 3.0,
    "upvote_ratio": 0.5,
    "num_comments": 2.0,
    "created_utc": 1.7e9,
    "url": "u",
    "selftext": "x",
}


def raw(spark, *changes):
    rows = [tuple((FULL | change)[c] for c in RAW_TYPES) for change in changes]
    return spark.createDataFrame(rows, ddl(RAW_TYPES))


def normalized(spark, *changes):
    return raw(spark, *changes).transform(normalize_posts).collect()


def test_columns_and_types(spark):
    wire = raw(spark, {}).transform(normalize_posts)
    assert wire.columns == WIRE_COLUMNS
    sent = WIRE_TYPES | dict.fromkeys(REQUIRED_WHOLE, "BIGINT")
    assert dict(wire.dtypes) == {name: kind.lower() for name, kind in sent.items()}


def test_missing_and_empty_texts_are_empty(spark):
    for gap in (None, ""):
        (row,) = normalized(spark, {"title": gap, "url": gap, "selftext": gap})
        assert (row.title, row.url, row.selftext) == ("", "", "")


def test_only_an_absent_author_is_unknown(spark):
    absent, empty, some = normalized(spark, {"author": None}, {"author": ""}, {})
    assert (absent.author, empty.author, some.author) == ("unknown", "", "bo")


def test_id_and_community_stay_as_they_are(spark):
    (row,) = normalized(spark, {"id": None, "subreddit": None})
    assert (row.id, row.subreddit) == (None, None)


def test_counts_are_truncated_toward_zero(spark):
    rows = normalized(spark, {"score": 1.9}, {"score": -1.9}, {"score": -0.5}, {"score": 0.0})
    assert [r.score for r in rows] == [1, -1, 0, 0]


def test_counts_beyond_int_are_kept(spark):
    rows = normalized(spark, {"score": 3e9}, {"score": -3e9})
    assert [r.score for r in rows] == [3_000_000_000, -3_000_000_000]


def test_counts_without_a_whole_value_are_null(spark):
    odd = [1e300, float("nan"), float("inf"), None]
    rows = normalized(spark, *({"score": x, "num_comments": x} for x in odd))
    assert [(r.score, r.num_comments) for r in rows] == [(None, None)] * len(odd)


def test_kept_columns_follow(spark):
    df = raw(spark, {}).selectExpr("*", "7 AS partition")
    assert df.transform(normalize_posts, ["partition"]).columns == [*WIRE_COLUMNS, "partition"]


def test_unusable_posts_are_named_and_others_are_not(spark):
    nan, inf = float("nan"), float("inf")
    cases = [
        ({}, None),
        ({"score": None}, "score"),
        ({"score": nan}, "score"),
        ({"num_comments": -inf}, "num_comments"),
        ({"score": None, "created_utc": None}, "score,created_utc"),
        ({"upvote_ratio": None}, "upvote_ratio"),
        # Any real number will do for these two, and a large count is still a count.
        ({"upvote_ratio": nan}, None),
        ({"created_utc": inf}, None),
        ({"score": 3e9}, None),
        ({"score": 1e300}, "score"),
        # Missing texts have defaults.
        ({"title": None, "author": None, "url": None, "selftext": None}, None),
    ]
    flagged = raw(spark, *(change for change, _ in cases)).transform(flag_unusable)
    assert [r.reject_reason for r in flagged.collect()] == [reason for _, reason in cases]
