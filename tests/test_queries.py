"""Every registered query against its SQL, under two session zones."""

import pytest
from conftest import SMALL

import __spark_entry__ as registered
from check import connect, differences
from feedlift.plans.oracles import ORACLES
from feedlift.plans.queries import QUERIES


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert registered.queries().items() >= QUERIES.items()
    assert registered.oracle_sql().items() >= ORACLES.items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, zone, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    assert got.num_rows > 0
    assert differences(connect(SMALL), got, ORACLES[name]) == ""


def test_entry(spark):
    rows = registered.entry(spark)
    assert rows.count() == spark.read.parquet(f"{SMALL}/events.parquet").count()
