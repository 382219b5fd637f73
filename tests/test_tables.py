"""The target table: made once, typed, bounded in length, appended or replaced."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedlift.operators.messages import read_posts
from feedlift.schema import TARGET_COLUMNS, TARGET_TYPES, target_read_types
from feedlift.sinks.table import (
    BATCH,
    RUN,
    append_to,
    append_to_table,
    ensure_table,
    replace_in_table,
)

GOOD = b'{"id":"a","title":"t","score":5,"created_utc":1700000000.9}'


@pytest.fixture
def name():
    return f"posts_{uuid.uuid4().hex}"


def test_made_once_with_the_declared_types(spark, name):
    for _ in range(2):
        ensure_table(spark, name)
    described = spark.sql(f"DESCRIBE {name}").collect()
    assert {r.col_name: r.data_type for r in described} == {
        column: kind.lower() for column, kind in TARGET_TYPES.items()
    }
    assert spark.table(name).isEmpty()


def test_an_existing_table_keeps_its_rows(spark, name, envelopes):
    ensure_table(spark, name)
    append_to_table(name)(envelopes([GOOD]).transform(read_posts), "run", 0)
    ensure_table(spark, name)
    assert spark.table(name).count() == 1


def test_appended_rows_add_up_in_any_column_order(spark, name, envelopes):
    ensure_table(spark, name)
    rows = envelopes([GOOD, b"junk", None]).transform(read_posts)
    append = append_to_table(name)
    append(rows, "run", 0)
    append(rows.select(TARGET_COLUMNS[::-1]), "run", 0)
    got = spark.table(name)
    assert dict(got.dtypes) == {c: k.lower() for c, k in target_read_types().items()}
    assert got.exceptAll(rows.unionByName(rows)).isEmpty() and got.count() == 6


def test_too_long_a_text_fails_the_write(spark, name, envelopes):
    ensure_table(spark, name)
    rows = envelopes([b'{"id":"%s"}' % (b"x" * 129)]).transform(read_posts)
    with pytest.raises(PySparkException, match="EXCEED_LIMIT_LENGTH"):
        append_to_table(name)(rows, "run", 0)
    assert spark.table(name).isEmpty()


def test_replacing_touches_one_batch_of_one_run(spark, name, envelopes):
    ensure_table(spark, name, replaces_batches=True)
    write = replace_in_table(name)

    def batch(*ids):
        return envelopes([b'{"id":"%s"}' % i for i in ids]).transform(read_posts)

    def content():
        rows = spark.table(name).groupBy(RUN, BATCH).agg(F.sort_array(F.collect_list("id")))
        return {(run, number): ids for run, number, ids in rows.collect()}

    write(batch(b"a", b"b"), "run1", 0)
    write(batch(b"c"), "run1", 1)
    write(batch(b"d"), "run2", 0)
    assert content() == {("run1", 0): ["a", "b"], ("run1", 1): ["c"], ("run2", 0): ["d"]}
    write(batch(b"e"), "run1", 0)
    assert content() == {("run1", 0): ["e"], ("run1", 1): ["c"], ("run2", 0): ["d"]}
    write(batch(b"f").limit(0), "run1", 0)
    assert content() == {("run1", 1): ["c"], ("run2", 0): ["d"]}


def test_a_table_of_another_provider_and_place(spark, name, envelopes, tmp_path):
    ensure_table(spark, name, provider="orc", location=str(tmp_path / "t"))
    append_to_table(name)(envelopes([GOOD]).transform(read_posts), "run", 0)
    assert spark.read.orc(str(tmp_path / "t")).count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_any_data_source_appends(spark, envelopes, tmp_path, fmt):
    rows = envelopes([GOOD, b"junk"]).transform(read_posts)
    write = append_to(fmt, path=str(tmp_path / fmt))
    for _ in range(2):
        write(rows, "run", 0)
    assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 4
