"""Options of the broker, paths of feeds, and the shared folder."""

import os
import types

import pytest

from conftest import SMALL
from feedlift.session import fresh_folder, shared_root
from feedlift.sinks.topic import _columns, kafka_sink_options
from feedlift.sources.feed import one_table, read_feed
from feedlift.sources.topic import kafka_source_options, read_topic
from feedlift.streaming.run import drain


def test_kafka_source_starts_at_the_end_and_is_bounded():
    options = kafka_source_options("host:9092", "posts")
    assert options["kafka.bootstrap.servers"] == "host:9092"
    assert options["subscribe"] == "posts"
    assert options["startingOffsets"] == "latest"
    assert int(options["maxOffsetsPerTrigger"]) > int(options["maxRecordsPerPartition"]) > 0


def test_kafka_source_options_given_win():
    extra = {"kafka.security.protocol": "SSL", "failOnDataLoss": "false"}
    options = kafka_source_options(
        "h:1", "t", startingOffsets="earliest", maxOffsetsPerTrigger=None, **extra
    )
    assert options["startingOffsets"] == "earliest"
    assert "maxOffsetsPerTrigger" not in options
    assert options.items() >= extra.items()


def test_kafka_sink_names_servers_and_topic():
    options = kafka_sink_options("h:1", "t", **{"kafka.acks": "all"})
    assert options == {"kafka.bootstrap.servers": "h:1", "topic": "t", "kafka.acks": "all"}


def test_a_broker_is_sent_values_only(spark):
    messages = spark.sql("SELECT X'00' AS value, 1 AS partition")
    assert _columns(messages, "kafka").columns == ["value"]
    assert _columns(messages, "parquet").columns == ["value", "partition"]


def test_the_broker_format_is_asked_for_by_name(spark):
    """Without the connector the session says which data source it misses."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic(spark, "kafka", kafka_source_options("h:1", "t"))


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_a_feed_may_be_one_file_or_a_folder(spark, tmp_path, layout):
    folder = SMALL
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    if layout == "folder":
        folder = str(tmp_path)
        events.repartition(3).write.parquet(f"{folder}/events.parquet")
    feed = read_feed(spark, one_table(folder, "events.parquet"), events.schema)
    counts = []
    drain(feed, lambda batch, number: counts.append(batch.count()), str(tmp_path / "checkpoint"))
    assert counts == [events.count()]


def test_a_feed_as_it_is_now(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    now = read_feed(spark, f"{SMALL}/events.parquet", events.schema, stream=False)
    assert not now.isStreaming and now.count() == events.count()


def test_the_bound_on_a_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    path = str(tmp_path / "feed")
    events.repartition(4).write.parquet(path)
    for options, batches in [
        ({}, 1),
        ({"maxBytesPerTrigger": None}, 1),
        ({"maxFilesPerTrigger": 1}, 4),
        ({"maxBytesPerTrigger": 1}, 4),
    ]:
        seen = []
        feed = read_feed(spark, path, events.schema, **options)
        checkpoint = f"{tmp_path}/{'-'.join(options)}-{batches}"
        drain(feed, lambda batch, number: seen.append(number), checkpoint)
        assert len(seen) == batches


@pytest.mark.parametrize(
    ("days", "options", "batches"),
    [(200, {}, 3), (100_000, {}, 3), (200, {"maxFileAge": "7d"}, 2)],
)
def test_a_file_with_an_old_date_is_not_lost(spark, tmp_path, days, options, batches):
    """Copied months late with its date kept, it is read, unless files may be forgotten."""
    path, checkpoint = tmp_path / "feed", str(tmp_path / "checkpoint")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    counts = []
    for days in (0, days, 0):
        before = set(path.glob("*.parquet"))
        events.write.mode("append").parquet(str(path))
        for new in set(path.glob("*.parquet")) - before:
            date = max(0, new.stat().st_mtime - days * 86_400)
            os.utime(new, (date, date))
        feed = read_feed(spark, str(path), events.schema, **options)
        drain(feed, lambda batch, number: counts.append(batch.count()), checkpoint)
    assert counts == [events.count()] * batches


def test_finished_files_move_to_the_archive(spark, tmp_path):
    path, archive = tmp_path / "feed", tmp_path / "archive"
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    clean = {"cleanSource": "archive", "sourceArchiveDir": str(archive)}
    counts = []
    for _ in range(3):
        events.write.mode("append").parquet(str(path))
        feed = read_feed(spark, str(path), events.schema, **clean)
        drain(feed, lambda batch, number: counts.append(batch.count()), str(tmp_path / "checkpoint"))
    assert counts == [events.count()] * 3
    assert list(archive.rglob("*.parquet"))


def test_the_cluster_names_the_shared_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    one, other = fresh_folder(spark, "x"), fresh_folder(spark, "x")
    assert one != other and one.startswith(shared_root(spark))


def session(master, **conf):
    get = types.SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
    return types.SimpleNamespace(conf=get, sparkContext=types.SimpleNamespace(master=master))


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(session("yarn"))
    assert shared_root(session("yarn", **{"spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    assert shared_root(session("local[8]")).startswith("/tmp/")
