from __future__ import annotations

import itertools

import pytest
from pyspark.sql import DataFrame, SparkSession

from feedlift.functions.epoch import utc_to_instant
from feedlift.schema import ENVELOPE_TYPES, ddl
from feedlift.session import local_session

ZONES = ["UTC", "America/New_York"]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    shared = str(tmp_path_factory.mktemp("shared"))
    conf = {
        "spark.checkpoint.dir": shared,
        "spark.sql.warehouse.dir": f"{shared}/warehouse",
        "spark.sql.shuffle.partitions": "8",
    }
    # As on a cluster, a task may fail three times before its job does.
    session = local_session("8,4", "tests", **conf)
    # Streams started and lost on purpose would fill the output with stack traces.
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=ZONES)
def zone(request, spark):
    """Run a test under several session zones; results must not depend on them."""
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def envelopes(spark):
    """Make an envelope of the given values, offsets counting up per partition."""
    numbers = itertools.count()

    def make(values: list[bytes | None], partition: int = 0) -> DataFrame:
        rows = [(None, v, "posts", partition, next(numbers), None, 0) for v in values]
        schema = ddl(ENVELOPE_TYPES | {"timestamp": "TIMESTAMP_NTZ"})
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("timestamp", utc_to_instant(df.timestamp))

    return make
