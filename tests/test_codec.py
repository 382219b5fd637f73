"""Messages: what decoding makes of good and bad text, and that encoding is its inverse."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedlift.functions.codec import CORRUPT, decode_record, encode_record
from feedlift.schema import WIRE_COLUMNS, WIRE_TYPES, ddl

SMILE = "é😀"
# Value, fields that are not NULL (None: the whole struct is), and whether it is flagged.
GOLDEN = [
    (b'{"id":"a"}', {"id": "a"}, False),
    (b'{"id":"a","zzz":1}', {"id": "a"}, False),
    (b'{"id":null,"score":null}', {}, False),
    (b'{"id":"a","score":12}', {"id": "a", "score": 12}, False),
    (b'{"id":"a","score":12.0}', {"id": "a"}, True),
    (b'{"id":"a","score":12.7}', {"id": "a"}, True),
    (b'{"id":"a","score":"12"}', {"id": "a"}, True),
    (b'{"id":"a","score":3000000000}', {"id": "a"}, True),
    (b'{"id":"a","score":"abc","upvote_ratio":0.5}', {"id": "a", "upvote_ratio": 0.5}, True),
    (b'{"id":"a","upvote_ratio":1}', {"id": "a", "upvote_ratio": 1.0}, False),
    (b'{"id":"a","upvote_ratio":"0.5"}', {"id": "a"}, True),
    (b'{"upvote_ratio":Infinity}', {"upvote_ratio": float("inf")}, False),
    (b'{"upvote_ratio":"-Infinity"}', {"upvote_ratio": float("-inf")}, False),
    (b'{"id":42}', {"id": "42"}, False),
    (b'{"id":{"k":1}}', {"id": '{"k":1}'}, False),
    (b'{"id":"a","score":', {}, True),
    (b"hello", {}, True),
    (b"5", {}, True),
    (b"null", {}, True),
    (b'[{"id":"a"},{"id":"b"}]', {}, True),
    (b"", None, False),
    (None, None, False),
    (b'{"id":"a","id":"b"}', {"id": "b"}, False),
    (b'{"ID":"a"}', {}, False),
    (b'{"id":"\\u00e9\\ud83d\\ude00"}', {"id": SMILE}, False),
    (f'{{"id":"{SMILE}"}}'.encode(), {"id": SMILE}, False),
    (b'{"id":"a"} junk', {"id": "a"}, False),
    (b"{'id':'a'}", {"id": "a"}, False),
    (b'{"id":"\xff\xfe"}', {"id": "��"}, False),
    (b'\xef\xbb\xbf{"id":"a"}', {}, True),
]


@pytest.mark.parametrize("keep_corrupt", [False, True])
def test_golden(spark, keep_corrupt):
    rows = [(i, bytearray(v) if v is not None else None) for i, (v, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i INT, value BINARY")
    json_ = decode_record(F.col("value"), keep_corrupt).alias("json")
    for row in df.select("i", json_).collect():
        value, fields, flagged = GOLDEN[row.i]
        if fields is None:
            assert row.json is None, value
            continue
        got = row.json.asDict()
        if keep_corrupt:
            assert (got.pop(CORRUPT) is not None) == flagged, value
        assert {k: v for k, v in got.items() if v is not None} == fields, value
        assert list(got) == WIRE_COLUMNS


def records():
    text = st.none() | st.text(st.characters(exclude_categories=["Cs"]), max_size=30)
    number = st.none() | st.integers(-(2**31), 2**31 - 1)
    real = st.none() | st.floats(allow_nan=False)
    kinds = {"STRING": text, "INT": number, "DOUBLE": real}
    return st.tuples(*(kinds[kind] for kind in WIRE_TYPES.values()))


@settings(max_examples=20, deadline=None)
@given(st.lists(records(), min_size=1, max_size=50), st.booleans())
def test_decoding_undoes_encoding(spark, rows, ascii_only):
    df = spark.createDataFrame(rows, ddl(WIRE_TYPES))
    value = encode_record(ascii_only=ascii_only)
    got = df.select(value.alias("value")).select("value", decode_record(F.col("value")).alias("j"))
    for row, want in zip(got.collect(), rows, strict=True):
        assert tuple(row.j) == want
        if ascii_only:
            assert bytes(row.value).isascii()


@settings(max_examples=20, deadline=None)
@given(st.lists(records(), min_size=1, max_size=50))
def test_agrees_with_another_json_library(spark, rows):
    """Our messages mean the same to Python's, and Python's the same to us."""
    rows = [r for r in rows if not any(isinstance(v, float) and abs(v) == float("inf") for v in r)]
    if not rows:
        return
    theirs = [json.dumps(dict(zip(WIRE_COLUMNS, r, strict=True))).encode() for r in rows]
    df = spark.createDataFrame(
        [(*r, bytearray(t)) for r, t in zip(rows, theirs, strict=True)],
        ddl(WIRE_TYPES | {"theirs": "BINARY"}),
    )
    out = df.select(encode_record().alias("ours"), decode_record(F.col("theirs")).alias("j"))
    for row, want in zip(out.collect(), rows, strict=True):
        assert tuple(row.j) == want
        assert tuple(json.loads(bytes(row.ours)).values()) == want


def test_what_json_has_no_number_for(spark):
    """NaN and infinities survive, as other libraries write them and as ours does."""
    theirs = json.dumps({"upvote_ratio": float("nan"), "created_utc": float("-inf")}).encode()
    df = spark.createDataFrame([(bytearray(theirs),)], "value BINARY")
    decoded = df.select(decode_record(F.col("value")).alias("j")).select("j.*")
    again = decoded.select(encode_record().alias("value"))
    for record in (decoded, again.select(decode_record(F.col("value")).alias("j")).select("j.*")):
        row = record.first()
        assert row.upvote_ratio != row.upvote_ratio and row.created_utc == float("-inf")


def test_nulls_are_written_out(spark):
    df = spark.createDataFrame([(None,) * len(WIRE_TYPES)], ddl(WIRE_TYPES))
    text = df.select(encode_record()).first()[0].decode()
    assert json.loads(text) == dict.fromkeys(WIRE_COLUMNS)
