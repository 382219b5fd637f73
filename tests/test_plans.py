"""Physical plans: one narrow stage, no Python, only the columns that are needed."""

import pytest

from conftest import SMALL
from feedlift.operators.placement import by_key
from feedlift.plans import delivery
from feedlift.plans.feeds import FEEDS, table
from feedlift.plans.queries import QUERIES

NARROW = [
    "normalize_posts", "normalize_unusable", "json_encode", "json_encode_ascii", "json_decode",
    "json_decode_bytes", "json_decode_malformed", "flatten_typed", "roundtrip_documents",
    "roundtrip_pages", "roundtrip_conversations", "lineage_columns", "epoch_to_string",
    "epoch_to_timestamp", "epoch_shipdates",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df) -> str:
    text = plan(df)
    return text[text.index("ReadSchema: "):].split("\n")[0]


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for word in ("Exchange", "Sort ", "Python", "ArrowEval", "Join", "Collect"):
        assert word not in text


@pytest.mark.parametrize("name", ["flatten_typed", "json_decode", "roundtrip_documents"])
def test_a_message_is_parsed_once(spark, name):
    assert plan(QUERIES[name](spark, SMALL)).count("from_json(") == 1


def test_only_the_parsing_is_not_compiled(spark):
    """Whole-stage code generation, marked by a star, spans what is around it."""
    text = plan(QUERIES["flatten_typed"](spark, SMALL))
    projects = [line for line in text.split("\n") if "Project [" in line]
    assert ["from_json(" in line for line in projects] == [False, True, False]
    assert ["*(" in line for line in projects] == [True, False, True]


def test_only_needed_columns_are_read(spark):
    shipped = QUERIES["epoch_shipdates"](spark, SMALL)
    assert scanned(shipped) == (
        "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>"
    )
    assert scanned(shipped.select("l_orderkey")) == "ReadSchema: struct<l_orderkey:bigint>"
    times = QUERIES["epoch_to_timestamp"](spark, SMALL)
    assert scanned(times) == "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>"


def test_lineage_alone_needs_no_message(spark):
    places = QUERIES["flatten_typed"](spark, SMALL).select("kafka_partition", "kafka_offset")
    assert scanned(places) == "ReadSchema: struct<event_id:bigint>"
    assert "from_json" not in plan(places)


def test_a_filter_on_lineage_reaches_the_scan(spark, tmp_path):
    from feedlift.operators.messages import read_posts
    from feedlift.sinks.topic import write_topic
    from feedlift.sources.topic import read_topic
    from feedlift.plans.queries import _envelope

    path = str(tmp_path / "topic")
    write_topic(_envelope(FEEDS["events"](spark, SMALL)), "parquet", {"path": path})
    topic = read_topic(spark, "parquet", {"path": path}, stream=False)
    text = plan(topic.transform(read_posts).where("kafka_offset >= 100"))
    assert "GreaterThanOrEqual(offset,100)" in text


@pytest.mark.parametrize(
    ("spread", "shuffle"),
    [
        (by_key("subreddit", salts=1), "REPARTITION_BY_COL"),
        (by_key("subreddit", 6, salts=1), "REPARTITION_BY_NUM"),
    ],
)
def test_placed_rows_are_counted_where_they_are(spark, spread, shuffle):
    """One shuffle places the rows; a count by their key needs no other."""
    rows = QUERIES["flatten_typed"](spark, SMALL)
    text = plan(rows.transform(spread).groupBy("subreddit").count())
    assert text.count("Exchange") == text.count(shuffle) == 1
    # What the query reads are the counts that were written, not the rows.
    text = plan(QUERIES["repartition_by_key"](spark, SMALL))
    assert "REPARTITION_BY" not in text and "from_json" not in text


def test_tables_are_read_whole(spark):
    for name in FEEDS:
        assert FEEDS[name](spark, SMALL).count() == table(spark, SMALL, name).count()


class _Written(Exception):
    """The topic is there: what reads it is not of interest."""


# How many tables each query sends to its topic in a batch job.
@pytest.mark.parametrize("name, tables", [
    ("placement_skewed", 3), ("sink_merge", 2), ("ingest_lag", 1), ("offset_gaps", 1),
    ("resume_without_checkpoint", 1), ("stream_dedup", 3),
])
def test_no_task_gets_a_whole_table(spark, monkeypatch, name, tables):
    written = []

    def read_topic(*args, **kwargs):
        raise _Written

    monkeypatch.setattr(
        delivery, "write_topic", lambda rows, *how: written.append(rows.rdd.getNumPartitions())
    )
    monkeypatch.setattr(delivery, "read_topic", read_topic)
    for setting in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{setting}", "1k")
    try:
        with pytest.raises(_Written):
            delivery.QUERIES[name](spark, SMALL)
    finally:
        for setting in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{setting}")
    assert len(written) == tables
    assert min(written) > 8
