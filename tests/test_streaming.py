"""Streams: equal to batches, resumed, replayed, empty, split, stopped."""

import os

import pytest
from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SMALL
from feedlift.operators.messages import read_posts
from feedlift.operators.placement import by_key, rebalance
from feedlift.plans.feeds import events_feed
from feedlift.schema import TARGET_COLUMNS, ddl, target_read_types
from feedlift.sinks.table import BATCH, RUN, append_to, replace_in_folder
from feedlift.sinks.topic import PLACE, place_as_files, stream_topic, write_topic
from feedlift.sources.topic import read_topic
from feedlift.streaming.batches import batch_writer, splitting_writer
from feedlift.streaming.ingest import posts_to_messages, start_folder_ingest, start_ingest
from feedlift.streaming import run
from feedlift.streaming.run import ALL_NOW, drain, has_progress, skip_existing, start_batches

N = 1000
JUNK_IN_PARTITION_0 = "CASE WHEN partition = 0 THEN X'6A756E6B' ELSE value END"


def envelope(spark):
    return place_as_files(posts_to_messages(events_feed(spark, SMALL), PLACE), "posts")


@pytest.fixture
def work(tmp_path):
    return str(tmp_path)


@pytest.fixture
def topic(spark, work):
    """A topic of eight files; returns a function that reads it as a stream."""
    path = f"{work}/topic"
    write_topic(envelope(spark).repartition(8), "parquet", {"path": path})

    def read(**options):
        return read_topic(spark, "parquet", {"path": path, **options})

    read.path = path
    return read


def target(spark, path):
    return spark.read.schema(ddl(target_read_types())).parquet(path).select(TARGET_COLUMNS)


def assert_whole(spark, path, copies=1):
    want = envelope(spark).transform(read_posts)
    got = target(spark, path)
    assert got.count() == copies * N
    assert got.distinct().exceptAll(want).isEmpty() and want.exceptAll(got.distinct()).isEmpty()


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_stream_equals_batch(spark, work, topic, batches):
    numbers = []

    def on_count(number, rows):
        numbers.append((number, rows))

    writer = batch_writer(replace_in_folder(f"{work}/out"), on_count=on_count)
    rows = topic(maxFilesPerTrigger=-(-8 // batches)).transform(read_posts)
    drain(rows, writer, f"{work}/checkpoint")
    assert_whole(spark, f"{work}/out")
    assert [number for number, _ in numbers] == list(range(batches))
    assert sum(rows for _, rows in numbers) == N


def test_the_source_is_read_once_per_batch(work, topic):
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    query = drain(topic().transform(read_posts), writer, f"{work}/checkpoint")
    assert query.lastProgress.numInputRows == N


def test_restart_without_news_runs_no_batch(work, topic):
    seen = []
    rows = topic()
    for _ in range(2):
        drain(rows, lambda batch, number: seen.append(number), f"{work}/checkpoint")
    assert seen == [0]


def test_resume_takes_only_what_is_new(spark, work, topic):
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    for _ in range(2):
        drain(topic().transform(read_posts), writer, f"{work}/checkpoint")
        assert_whole(spark, f"{work}/out")
    write_topic(envelope(spark), "parquet", {"path": topic.path})
    drain(topic().transform(read_posts), writer, f"{work}/checkpoint")
    assert_whole(spark, f"{work}/out", copies=2)


def lose_once(writer, at=0):
    """The same writer, but the driver is lost once between a write and its commit."""
    lost = []

    def write_batch(batch, number):
        writer(batch, number)
        if number == at and not lost:
            lost.append(number)
            raise RuntimeError("lost")

    return write_batch


@pytest.mark.parametrize("at", [0, 1])
def test_rerun_replaces_its_batch(spark, work, topic, at):
    writer = lose_once(batch_writer(replace_in_folder(f"{work}/out")), at)
    rows = topic(maxFilesPerTrigger=4).transform(read_posts)
    with pytest.raises(StreamingQueryException):
        drain(rows, writer, f"{work}/checkpoint")
    drain(rows, writer, f"{work}/checkpoint")
    assert_whole(spark, f"{work}/out")


def test_rerun_appends_again_where_it_only_appends(spark, work, topic):
    writer = lose_once(batch_writer(append_to("parquet", path=f"{work}/out")))
    rows = topic().transform(read_posts)
    with pytest.raises(StreamingQueryException):
        drain(rows, writer, f"{work}/checkpoint")
    drain(rows, writer, f"{work}/checkpoint")
    assert_whole(spark, f"{work}/out", copies=2)


def test_a_new_checkpoint_leaves_the_old_batches_alone(spark, work, topic):
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    for checkpoint in ("one", "two"):
        drain(topic().transform(read_posts), writer, f"{work}/{checkpoint}")
    assert_whole(spark, f"{work}/out", copies=2)
    runs = spark.read.parquet(f"{work}/out").select(RUN, BATCH).distinct().collect()
    assert len({row[RUN] for row in runs}) == 2 and {row[BATCH] for row in runs} == {0}


@pytest.mark.parametrize("skip_empty", [False, True])
def test_an_empty_batch_adds_no_rows(spark, work, topic, skip_empty):
    counts = []
    writer = batch_writer(
        replace_in_folder(f"{work}/out"),
        on_count=lambda number, rows: counts.append(rows),
        skip_empty=skip_empty,
    )
    nothing = topic().where("offset < 0")
    drain(nothing.transform(read_posts), writer, f"{work}/checkpoint")
    assert counts == ([] if skip_empty else [0])
    write_topic(envelope(spark), "parquet", {"path": topic.path})
    drain(topic().transform(read_posts), writer, f"{work}/checkpoint")
    assert counts[-1] == N
    assert_whole(spark, f"{work}/out")


def test_skip_existing(spark, work, topic):
    checkpoint = f"{work}/checkpoint"
    assert not has_progress(spark, checkpoint)
    skip_existing(topic(maxBytesPerTrigger=None), checkpoint)
    assert has_progress(spark, checkpoint)
    write_topic(envelope(spark), "parquet", {"path": topic.path})
    # A restart must not skip what came while the stream was down.
    skip_existing(topic(maxBytesPerTrigger=None), checkpoint)
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    drain(topic().transform(read_posts), writer, checkpoint)
    assert_whole(spark, f"{work}/out")


def test_a_skip_that_died_half_way_is_finished(spark, work, topic, monkeypatch):
    """Only what it had planned is skipped: what came since is not."""
    checkpoint = f"{work}/checkpoint"

    def dies(rows, write_batch, place):
        def lost(batch, number):
            raise RuntimeError("lost")

        drain(rows, lost, place)

    with monkeypatch.context() as patch:
        patch.setattr(run, "drain", dies)
        with pytest.raises(StreamingQueryException):
            skip_existing(topic(maxBytesPerTrigger=None), checkpoint)
    write_topic(envelope(spark), "parquet", {"path": topic.path})
    for _ in range(2):
        skip_existing(topic(maxBytesPerTrigger=None), checkpoint)
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    drain(topic().transform(read_posts), writer, checkpoint)
    assert_whole(spark, f"{work}/out")


def test_a_skip_lost_before_its_first_batch_skips_nothing_twice(spark, work, topic, monkeypatch):
    checkpoint = f"{work}/checkpoint"
    with monkeypatch.context() as patch:
        patch.setattr(run, "drain", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            skip_existing(topic(maxBytesPerTrigger=None), checkpoint)
    skip_existing(topic(maxBytesPerTrigger=None), checkpoint)
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    drain(topic().transform(read_posts), writer, checkpoint)
    assert_whole(spark, f"{work}/out")


def test_a_stream_in_progress_is_not_skipped_later(spark, work, topic):
    checkpoint = f"{work}/checkpoint"
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    failing = lose_once(writer)
    with pytest.raises(StreamingQueryException):
        drain(topic().transform(read_posts), failing, checkpoint)
    skip_existing(topic(maxBytesPerTrigger=None).transform(read_posts), checkpoint)
    drain(topic().transform(read_posts), writer, checkpoint)
    assert_whole(spark, f"{work}/out")


def test_progress_is_known_after_old_commits_are_gone(spark, work, topic):
    """Spark deletes the commits of old batches."""
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "1")
    try:
        drain(topic(maxFilesPerTrigger=1), lambda batch, number: None, f"{work}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
    assert not os.path.exists(f"{work}/checkpoint/commits/0")
    assert has_progress(spark, f"{work}/checkpoint")


def test_spread_before_the_write(spark, work, topic):
    spread = by_key("subreddit", 5, salts=1)
    drain(
        topic().transform(read_posts),
        batch_writer(replace_in_folder(f"{work}/out"), spread=spread),
        f"{work}/checkpoint",
    )
    assert_whole(spark, f"{work}/out")
    files = spark.read.parquet(f"{work}/out").select("subreddit", F.input_file_name()).distinct()
    assert files.count() == files.select("subreddit").distinct().count()


def test_adaptive_execution_applies_within_a_batch(work, topic):
    """What ``rebalance`` relies on."""
    plans = []

    def look(batch, number):
        spread = batch.transform(rebalance("subreddit"))
        plans.append(spread._jdf.queryExecution().executedPlan().toString())

    drain(topic().transform(read_posts), look, f"{work}/checkpoint")
    assert "AdaptiveSparkPlan" in plans[0] and "REBALANCE_PARTITIONS_BY_COL" in plans[0]


def test_split(spark, work, topic):
    damaged = topic().withColumn("value", F.expr(JUNK_IN_PARTITION_0))
    query = start_ingest(
        damaged,
        f"{work}/checkpoint",
        replace_in_folder(f"{work}/out"),
        replace_in_folder(f"{work}/rejects"),
        spread=by_key("subreddit"),
        trigger=ALL_NOW,
    )
    query.awaitTermination()
    # Two writes, but the batch was read and decoded once.
    assert query.lastProgress.numInputRows == N
    good, rejects = target(spark, f"{work}/out"), spark.read.parquet(f"{work}/rejects")
    assert good.where("kafka_partition = 0").isEmpty()
    assert rejects.where("reject_reason != 'unreadable' OR raw_value != X'6A756E6B'").isEmpty()
    assert rejects.where("kafka_partition != 0").isEmpty()
    assert good.count() + rejects.count() == N
    assert "reject_reason" not in spark.read.parquet(f"{work}/out").columns


def test_split_counts_both_sides(spark, work, topic):
    flagged = topic().withColumn("reject_reason", F.expr("IF(partition = 0, 'zero', NULL)"))
    counts = {}
    splitter = splitting_writer(
        replace_in_folder(f"{work}/out"),
        replace_in_folder(f"{work}/rejects"),
        lambda good: good,
        on_count=lambda number, rows: counts.update(rows=rows),
        on_rejects=lambda number, rows: counts.update(rejects=rows),
    )
    drain(flagged, splitter, f"{work}/checkpoint")
    zero = envelope(spark).where("partition = 0").count()
    assert counts == {"rows": N - zero, "rejects": zero}


def test_a_failed_write_of_rejects_repeats_no_row(spark, work, topic):
    """Rejects, which replace their batch, go first."""
    flagged = topic().withColumn("reject_reason", F.expr("IF(partition = 0, 'zero', NULL)"))
    aside = replace_in_folder(f"{work}/rejects")
    failed = []

    def once(batch, run_id, number):
        aside(batch, run_id, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("no disk")

    splitter = splitting_writer(append_to("parquet", path=f"{work}/out"), once, lambda good: good)
    with pytest.raises(StreamingQueryException):
        drain(flagged, splitter, f"{work}/checkpoint")
    drain(flagged, splitter, f"{work}/checkpoint")
    zero = envelope(spark).where("partition = 0").count()
    assert spark.read.parquet(f"{work}/out").count() == N - zero
    assert spark.read.parquet(f"{work}/rejects").count() == zero


@pytest.mark.parametrize("skip_empty", [False, True])
def test_an_empty_batch_is_split_only_if_asked_for(work, topic, skip_empty):
    counts = []
    splitter = splitting_writer(
        replace_in_folder(f"{work}/out"),
        replace_in_folder(f"{work}/rejects"),
        lambda good: good,
        on_count=lambda number, rows: counts.append(rows),
        skip_empty=skip_empty,
    )
    flagged = topic().where("offset < 0").withColumn("reject_reason", F.lit(None).cast("string"))
    drain(flagged, splitter, f"{work}/checkpoint")
    assert counts == ([] if skip_empty else [0])
    assert os.path.exists(f"{work}/rejects") != skip_empty


def test_one_folder_for_rows_and_rejects(spark, work, topic):
    damaged = topic().withColumn("value", F.expr(JUNK_IN_PARTITION_0))
    query = start_folder_ingest(damaged, f"{work}/out", f"{work}/checkpoint", trigger=ALL_NOW)
    query.awaitTermination()
    assert query.lastProgress.numInputRows == N
    rows = spark.read.parquet(f"{work}/out")
    rejects = rows.where("outcome = 'reject'")
    assert rejects.where("kafka_partition != 0 OR reject_reason != 'unreadable'").isEmpty()
    assert rows.where("outcome = 'row' AND kafka_partition = 0").isEmpty()
    assert rows.count() == N and not rejects.isEmpty()
    assert "PartitionFilters: [isnotnull(outcome" in rejects._jdf.queryExecution().toString()


def test_split_releases_the_batch_when_a_write_fails(work, topic):
    def failing(batch, run, number):
        raise RuntimeError("no disk")

    splitter = splitting_writer(replace_in_folder(f"{work}/out"), failing, lambda good: good)
    kept = []

    def watched(batch, number):
        try:
            splitter(batch, number)
        finally:
            kept.append(batch.storageLevel)

    flagged = topic().withColumn("reject_reason", F.lit(None).cast("string"))
    with pytest.raises(StreamingQueryException, match="no disk"):
        drain(flagged, watched, f"{work}/checkpoint")
    assert kept == [StorageLevel.NONE]


def test_a_failed_preparation_keeps_the_stream_from_starting(spark, work, topic):
    def prepare():
        raise RuntimeError("no such warehouse")

    write = replace_in_folder(f"{work}/out")
    with pytest.raises(RuntimeError, match="no such warehouse"):
        start_ingest(topic(), f"{work}/checkpoint", write, prepare=prepare)
    assert not has_progress(spark, f"{work}/checkpoint")
    assert spark.streams.active == []


def test_runs_until_stopped(spark, work, topic):
    """With no trigger a batch starts when the last ends, until the query is stopped."""
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    query = start_batches(
        topic().transform(read_posts), writer, f"{work}/checkpoint", name="running"
    )
    query.processAllAvailable()
    write_topic(envelope(spark), "parquet", {"path": topic.path})
    query.processAllAvailable()
    assert query.isActive and query.name == "running"
    query.stop()
    assert_whole(spark, f"{work}/out", copies=2)


def test_interval_trigger(spark, work, topic):
    writer = batch_writer(replace_in_folder(f"{work}/out"))
    query = start_batches(
        topic(maxFilesPerTrigger=4).transform(read_posts),
        writer,
        f"{work}/checkpoint",
        {"processingTime": "200 milliseconds"},
    )
    query.processAllAvailable()
    query.stop()
    assert_whole(spark, f"{work}/out")


def test_publish_resumes(spark, work):
    """The feed's stream goes on where it was, and nothing is sent twice."""
    feed, options = f"{work}/feed", {"path": f"{work}/sent"}
    envelope(spark).write.parquet(feed)
    for _ in range(2):
        messages = read_topic(spark, "parquet", {"path": feed})
        stream_topic(messages, f"{work}/checkpoint", "parquet", options, ALL_NOW).awaitTermination()
    assert read_topic(spark, "parquet", options, stream=False).count() == N
