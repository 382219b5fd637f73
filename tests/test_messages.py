"""Envelopes to typed rows, with and without setting messages aside."""

import datetime as dt

from pyspark.sql import functions as F

from feedlift.operators.messages import (
    decode_messages,
    encode_messages,
    read_posts,
    read_posts_flagged,
    with_lineage,
)
from feedlift.schema import (
    LINEAGE_COLUMNS,
    TARGET_COLUMNS,
    WIRE_COLUMNS,
    WIRE_TYPES,
    ddl,
    length_limits,
    target_read_types,
)

GOOD = b'{"id":"a","title":"t","score":5,"created_utc":1700000000.9}'


def test_lineage_is_renamed_and_nothing_else_passes(envelopes):
    assert envelopes([GOOD]).transform(with_lineage).columns == ["value", *LINEAGE_COLUMNS]


def test_types_of_the_target(envelopes):
    rows = envelopes([GOOD]).transform(read_posts)
    want = {name: kind.lower() for name, kind in target_read_types().items()}
    assert dict(rows.dtypes) == want
    assert rows.columns == TARGET_COLUMNS


def test_a_message_becomes_a_row(envelopes):
    row = envelopes([GOOD], partition=4).transform(read_posts).first()
    assert (row.id, row.title, row.score, row.author) == ("a", "t", 5, None)
    assert row.created_utc == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert (row.kafka_partition, row.kafka_offset) == (4, 0)


def test_kafka_timestamp_is_utc_under_any_zone(spark, zone, envelopes):
    moment = F.timestamp_micros(F.lit(1_730_615_400_123_456))
    row = envelopes([GOOD]).withColumn("timestamp", moment).transform(read_posts).first()
    assert row.kafka_timestamp == dt.datetime(2024, 11, 3, 6, 30, 0, 123456)


def test_unreadable_messages_stay_as_rows(envelopes):
    values = [GOOD, b"hello", b"", None, b'{"id":', b"[1]"]
    rows = envelopes(values).transform(read_posts).orderBy("kafka_offset").collect()
    assert [r.kafka_offset for r in rows] == list(range(len(values)))
    assert [r.id for r in rows] == ["a", None, None, None, None, None]
    for row in rows[1:]:
        assert [row[c] for c in WIRE_COLUMNS] == [None] * len(WIRE_COLUMNS)


def test_an_absurd_time_does_not_fail_the_batch(envelopes):
    values = [b'{"created_utc":NaN}', b'{"created_utc":1e300}', b'{"created_utc":-1.5}']
    rows = envelopes(values).transform(read_posts).orderBy("kafka_offset").collect()
    assert [r.created_utc for r in rows] == [None, None, dt.datetime(1969, 12, 31, 23, 59, 59)]


def test_flags(envelopes):
    limits = length_limits()
    long_title = b'{"title":"%s"}' % (b"x" * (limits["title"] + 1))
    full_title = '{"title":"%s"}' % ("é" * limits["title"])
    two = b'{"id":"%s","url":"%s"}' % (b"x" * (limits["id"] + 1), b"x" * (limits["url"] + 1))
    cases = [
        (GOOD, None),
        (b"hello", "unreadable"),
        (b"", "unreadable"),
        (None, "unreadable"),
        (b'{"score":"5"}', "unreadable"),
        (b'{"other":1}', None),
        (long_title, "too long: title"),
        (full_title.encode(), None),
        (two, "too long: id; too long: url"),
    ]
    flagged = envelopes([value for value, _ in cases]).transform(read_posts_flagged)
    rows = flagged.orderBy("kafka_offset").collect()
    assert flagged.columns == [*TARGET_COLUMNS, "reject_reason", "raw_value"]
    assert [r.reject_reason for r in rows] == [reason for _, reason in cases]
    for row, (value, reason) in zip(rows, cases, strict=True):
        assert row.raw_value == (bytearray(value) if reason and value is not None else None)


def test_flagged_rows_are_otherwise_the_same(envelopes):
    df = envelopes([GOOD, b"hello", b'{"score":"5"}'])
    flagged = df.transform(read_posts_flagged).select(TARGET_COLUMNS)
    assert flagged.exceptAll(df.transform(read_posts)).isEmpty()


def test_a_long_text_passes_whole(spark, envelopes):
    text = "Größe 😀 \\ \" \n\t\u0000 " * 20_000
    wire = spark.createDataFrame([tuple(text if c == "selftext" else None for c in WIRE_TYPES)],
                                 ddl(WIRE_TYPES))
    assert wire.transform(encode_messages).transform(decode_messages).first().json.selftext == text
