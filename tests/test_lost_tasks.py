"""Tasks that fail at their first attempt: what is written is whole, each row once."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from conftest import SMALL
from feedlift.operators.messages import read_posts, read_posts_flagged
from feedlift.operators.placement import by_key, rebalance
from feedlift.plans.feeds import events_feed
from feedlift.schema import TARGET_COLUMNS
from feedlift.sinks.table import append_to, ensure_table, replace_in_folder, replace_in_table
from feedlift.sinks.topic import PLACE, place_as_files, stream_topic, write_topic
from feedlift.sources.topic import read_topic
from feedlift.streaming.batches import batch_writer, splitting_writer
from feedlift.streaming.ingest import posts_to_messages
from feedlift.streaming.run import ALL_NOW, drain


def failing_first(df):
    """The same rows, but every other task is lost once, after some of its rows."""

    def lose(batches):
        context = TaskContext.get()
        doomed = context.attemptNumber() == 0 and context.partitionId() % 2 == 0
        for batch in batches:
            yield batch
            if doomed:
                raise RuntimeError("executor lost")

    return df.mapInArrow(lose, df.schema)


@pytest.fixture
def topic(spark, tmp_path):
    envelope = place_as_files(posts_to_messages(events_feed(spark, SMALL), PLACE), "posts")
    path = str(tmp_path / "topic")
    write_topic(envelope.repartition(8), "parquet", {"path": path})
    return lambda stream=True: read_topic(spark, "parquet", {"path": path}, stream)


def assert_same(got, topic):
    want = topic(stream=False).transform(read_posts)
    got = got.select(TARGET_COLUMNS)
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).isEmpty()


SPREADS = {
    "none": None,
    "rebalance": rebalance(),
    "rebalance by key": rebalance("subreddit"),
    "salted": by_key("subreddit", 6),
    "by key": by_key("subreddit", 6, salts=1),
}


@pytest.mark.parametrize("spread", SPREADS)
@pytest.mark.parametrize("make", [replace_in_folder, lambda path: append_to("parquet", path=path)])
def test_folders(spark, tmp_path, topic, make, spread):
    out = str(tmp_path / "out")
    rows = failing_first(topic().transform(read_posts))
    drain(rows, batch_writer(make(out), SPREADS[spread]), str(tmp_path / "checkpoint"))
    assert_same(spark.read.parquet(out), topic)


def test_table(spark, tmp_path, topic):
    ensure_table(spark, "lost_tasks", location=str(tmp_path / "t"), replaces_batches=True)
    rows = failing_first(topic().transform(read_posts))
    drain(rows, batch_writer(replace_in_table("lost_tasks")), str(tmp_path / "checkpoint"))
    assert_same(spark.table("lost_tasks"), topic)


def test_split(spark, tmp_path, topic):
    flagged = failing_first(topic().transform(read_posts_flagged))
    flagged = flagged.withColumn("reject_reason", F.expr("IF(kafka_offset % 5 = 0, 'x', NULL)"))
    out, aside = str(tmp_path / "out"), str(tmp_path / "aside")
    splitter = splitting_writer(replace_in_folder(out), replace_in_folder(aside), lambda df: df)
    drain(flagged, splitter, str(tmp_path / "checkpoint"))
    assert_same(spark.read.parquet(out).unionByName(spark.read.parquet(aside)), topic)


def test_topic(spark, tmp_path, topic):
    options = {"path": str(tmp_path / "sent")}
    checkpoint = str(tmp_path / "checkpoint")
    stream_topic(failing_first(topic()), checkpoint, "parquet", options, ALL_NOW).awaitTermination()
    assert_same(read_topic(spark, "parquet", options, stream=False).transform(read_posts), topic)
