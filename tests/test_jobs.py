"""The command lines, end to end over files."""

import os

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException

from conftest import SMALL
from feedlift.jobs import ingest, publish
from feedlift.operators.messages import read_posts
from feedlift.plans.feeds import events_feed
from feedlift.plans.queries import _envelope
from feedlift.schema import ENVELOPE_TYPES, RAW_TYPES, TARGET_COLUMNS
from feedlift.sinks.table import ensure_table
from feedlift.sinks.topic import PLACE
from feedlift.sources.topic import read_topic

BROKER = ["--topic-option", "kafka.bootstrap.servers=h:1"]


@pytest.mark.parametrize(
    ("parse", "argv", "named"),
    [
        (ingest.parse, [], "--table"),
        (ingest.parse, ["--folder", "t"], "kafka.bootstrap.servers, subscribe"),
        (ingest.parse, ["--table", "t", "--all-now", *BROKER], "subscribe"),
        (ingest.parse, ["--table", "t", *BROKER], "--every"),
        (ingest.parse, ["--table", "t", "--all-now", "--rejects", *BROKER], "--rejects"),
        (ingest.parse, ["--table", "t", "--all-now", "--lengths", "enforce", *BROKER], "--rejects"),
        (ingest.parse, ["--folder", "f", "--outcomes", "--rejects", "r", *BROKER], "--outcomes"),
        (ingest.parse, ["--folder", "t", "--topic-format", "parquet"], "path"),
        (ingest.parse, ["--table", "t", "--folder", "f"], "not allowed"),
        (ingest.parse, ["--table", "t", "--topic-option", "nonsense"], "name=value"),
        (ingest.parse, ["--table", "t", "--outcomes", *BROKER], "--folder"),
        (publish.parse, ["--feed", "f", *BROKER], "missing --topic-option: topic"),
        (publish.parse, [], "--feed"),
    ],
)
def test_what_is_missing_is_named(capsys, parse, argv, named):
    with pytest.raises(SystemExit):
        parse(argv)
    assert named in capsys.readouterr().err


def test_arguments():
    argv = ["--table", "t", "--at-least-once", *BROKER, "--topic-option", "subscribe=a=b"]
    got = ingest.parse([*argv, "--every", "5 s"])
    assert got.topic == {"kafka.bootstrap.servers": "h:1", "subscribe": "a=b"}
    assert ingest.trigger(got) == {"processingTime": "5 s"}
    assert ingest.trigger(ingest.parse(argv)) is None


def feed_files(spark, path, mode="append"):
    columns = [f"CAST({c} AS {t}) AS {c}" for c, t in RAW_TYPES.items()]
    columns += [f"CAST({c} AS {ENVELOPE_TYPES[c]}) AS {c}" for c in PLACE]
    events_feed(spark, SMALL).selectExpr(*columns).write.mode(mode).parquet(path)


def run_publish(spark, work, *extra):
    arguments = publish.parse([
        "--feed", f"{work}/feed", "--topic-format", "parquet",
        "--topic-option", f"path={work}/topic", "--checkpoint", f"{work}/publish",
        "--all-now", *extra,
    ])
    publish.start(spark, arguments).awaitTermination()


def run_ingest(spark, work, *extra):
    arguments = ingest.parse([
        "--topic-format", "parquet", "--topic-option", f"path={work}/topic",
        "--checkpoint", f"{work}/ingest", "--all-now", *extra,
    ])
    ingest.start(spark, arguments).awaitTermination()


def assert_all(spark, got, copies=1):
    want = _envelope(events_feed(spark, SMALL)).transform(read_posts)
    got = got.select(TARGET_COLUMNS)
    assert got.count() == copies * want.count()
    assert got.exceptAll(want).count() == (copies - 1) * want.count()


@pytest.mark.parametrize("rejects", [False, True])
def test_feed_to_table(spark, tmp_path, rejects):
    work, table = str(tmp_path), f"jobs_{rejects}".lower()
    aside = ["--rejects", f"{work}/aside"] if rejects else []
    feed_files(spark, f"{work}/feed")
    run_publish(spark, work, "--include-existing", *aside)
    for _ in range(2):
        run_ingest(spark, work, "--table", table, "--location", f"{work}/table", *aside)
        assert_all(spark, spark.table(table))


def test_what_is_there_is_skipped_once(spark, tmp_path):
    work = str(tmp_path)
    feed_files(spark, f"{work}/feed")
    run_publish(spark, work)
    feed_files(spark, f"{work}/feed")
    run_publish(spark, work)
    topic = read_topic(spark, "parquet", {"path": f"{work}/topic"}, False)
    assert_all(spark, topic.transform(read_posts))


def test_unusable_posts_go_aside(spark, tmp_path):
    work = str(tmp_path)
    feed_files(spark, f"{work}/feed")
    feed = spark.read.parquet(f"{work}/feed").selectExpr(
        "* EXCEPT (score)", "CASE WHEN partition > 0 THEN score END AS score"
    )
    feed.write.parquet(f"{work}/gaps/feed")
    run_publish(spark, f"{work}/gaps", "--include-existing", "--rejects", f"{work}/aside")
    sent = read_topic(spark, "parquet", {"path": f"{work}/gaps/topic"}, False)
    aside = spark.read.parquet(f"{work}/aside")
    assert sent.where("partition = 0").isEmpty() and aside.where("partition != 0").isEmpty()
    assert aside.where("reject_reason != 'score'").isEmpty()
    assert sent.count() + aside.count() == feed.count()


@pytest.mark.parametrize(
    "target",
    [
        ["--folder", "{}/out"],
        ["--folder", "{}/out", "--spread", "rebalance"],
        ["--folder", "{}/out", "--outcomes"],
        ["--folder", "{}/out", "--spread", "key", "--skip-empty"],
        ["--folder", "{}/out", "--spread", "fixed", "--partitions", "3"],
        ["--folder", "{}/out", "--rejects"],
        ["--folder", "{}/out", "--rejects", "{}/aside", "--skip-empty"],
        ["--sink-format", "parquet", "--sink-option", "path={}/out"],
    ],
)
def test_other_targets(spark, tmp_path, target):
    work = str(tmp_path)
    _envelope(events_feed(spark, SMALL)).write.parquet(f"{work}/topic")
    run_ingest(spark, work, *(part.format(work) for part in target))
    assert_all(spark, spark.read.parquet(f"{work}/out"))


def test_appending_to_a_table_and_skipping(spark, tmp_path):
    work = str(tmp_path)
    append = ["--table", "jobs_append", "--location", f"{work}/t"]
    append += ["--at-least-once", "--skip-existing"]
    for copies in (0, 1, 2):
        _envelope(events_feed(spark, SMALL)).write.mode("append").parquet(f"{work}/topic")
        run_ingest(spark, work, *append)
        if copies:
            spark.catalog.refreshTable("jobs_append")
        assert spark.table("jobs_append").count() == copies * events_feed(spark, SMALL).count()


def test_a_first_batch_that_failed_is_written_after_an_empty_start(spark, tmp_path):
    """Skipping what is there is a decision of the first start, also when nothing is."""
    work = str(tmp_path)
    os.makedirs(f"{work}/feed")
    run_publish(spark, work, "--counts", "DOUBLE")
    feed_files(spark, f"{work}/feed")
    # The place of the topic's data is taken by a file: the first batch is planned, its write fails.
    data = tmp_path / "topic" / "topic-data"
    data.write_text("in the way")
    with pytest.raises(StreamingQueryException):
        run_publish(spark, work)
    data.rename(tmp_path / "aside")
    run_publish(spark, work)
    assert_all(spark, read_topic(spark, "parquet", {"path": f"{work}/topic"}, False).transform(read_posts))


@pytest.mark.parametrize("rejects", [False, True])
def test_files_that_come_while_the_job_is_down_are_published(spark, tmp_path, rejects):
    work = str(tmp_path)
    aside = ["--rejects", f"{work}/aside"] if rejects else []
    os.makedirs(f"{work}/feed")
    run_publish(spark, work, "--counts", "DOUBLE", *aside)
    feed_files(spark, f"{work}/feed")
    run_publish(spark, work, *aside)
    assert_all(spark, read_topic(spark, "parquet", {"path": f"{work}/topic"}, False).transform(read_posts))


def test_messages_that_come_while_the_job_is_down_are_ingested(spark, tmp_path):
    work = str(tmp_path)
    os.makedirs(f"{work}/topic")
    run_ingest(spark, work, "--folder", f"{work}/out", "--skip-existing")
    _envelope(events_feed(spark, SMALL)).write.mode("append").parquet(f"{work}/topic")
    run_ingest(spark, work, "--folder", f"{work}/out", "--skip-existing")
    assert_all(spark, spark.read.parquet(f"{work}/out"))


def test_with_and_without_rejects_one_topic(spark, tmp_path):
    work = str(tmp_path)
    feed_files(spark, f"{work}/feed")
    run_publish(spark, work, "--include-existing")
    feed_files(spark, f"{work}/feed")
    run_publish(spark, work, "--rejects", f"{work}/aside")
    topic = read_topic(spark, "parquet", {"path": f"{work}/topic"}, False)
    assert_all(spark, topic.transform(read_posts), copies=2)


def test_a_topic_with_the_log_of_a_file_sink_is_refused(spark, tmp_path):
    work = str(tmp_path)
    feed_files(spark, f"{work}/feed")
    stream = spark.readStream.schema("value STRING").format("text").load(f"{work}/feed")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/old").trigger(
        availableNow=True
    ).start(f"{work}/topic").awaitTermination()
    with pytest.raises(ValueError, match="log of a file sink"):
        run_publish(spark, work, "--include-existing")


def test_checkpoints_are_named_by_both_ends(spark, tmp_path, monkeypatch):
    def ingest_place(*target, topic="a"):
        path = tmp_path / topic
        path.mkdir(exist_ok=True)
        arguments = ingest.parse(
            ["--topic-format", "parquet", "--topic-option", f"path={path}", "--all-now", *target]
        )
        taken = {}
        for name in ("start_ingest", "start_table_ingest"):
            at = 1 if name == "start_ingest" else 3
            monkeypatch.setattr(ingest, name, lambda *a, at=at, **b: taken.update(place=a[at]))
        ingest.start(spark, arguments)
        return taken["place"]

    targets = [
        ("--table", "lake.posts"),
        ("--table", "lake_posts"),
        ("--folder", "lake/posts"),
        ("--folder", "lake-posts"),
        ("--sink-format", "orc", "--sink-option", "path=a"),
        ("--sink-format", "orc", "--sink-option", "path=b"),
    ]
    places = [ingest_place(*target) for target in targets]
    places += [ingest_place(*target, topic="b") for target in targets]
    assert len(set(places)) == len(places)
    assert places[: len(targets)] == [ingest_place(*target) for target in targets]
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(place.startswith(root) for place in places)


def test_no_checkpoint_in_a_folder_of_the_process():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    arguments = ingest.parse(["--folder", "f", *BROKER, "--topic-option", "subscribe=a"])
    with pytest.raises(SystemExit, match="--checkpoint"):
        ingest.start(Unset, arguments)


@pytest.mark.parametrize("kind", ["INT", "BIGINT", "DOUBLE", "FLOAT"])
def test_a_feed_of_any_numeric_type(spark, tmp_path, kind):
    work = str(tmp_path)
    feed_files(spark, f"{work}/as_double")
    posts = spark.read.parquet(f"{work}/as_double")
    counts = {c: posts[c].cast(kind) for c in ("score", "num_comments")}
    posts.withColumns(counts).write.parquet(f"{work}/feed")
    run_publish(spark, work, "--include-existing")
    assert_all(spark, read_topic(spark, "parquet", {"path": f"{work}/topic"}, False).transform(read_posts))


def test_a_table_with_bounded_texts_needs_a_place_for_longer_ones(spark, tmp_path):
    work = str(tmp_path)
    _envelope(events_feed(spark, SMALL)).write.parquet(f"{work}/topic")
    ensure_table(spark, "jobs_bounded", replaces_batches=True)
    with pytest.raises(ValueError, match="title"):
        run_ingest(spark, work, "--table", "jobs_bounded")
    run_ingest(spark, work, "--table", "jobs_bounded", "--rejects", f"{work}/aside")
    assert_all(spark, spark.table("jobs_bounded"))


def test_a_sink_that_cannot_be_read_stops_the_job_first(spark, tmp_path):
    work = str(tmp_path)
    _envelope(events_feed(spark, SMALL)).write.parquet(f"{work}/topic")
    sink = ["--sink-format", "parquet", "--sink-option", f"path={work}/out", "--look-first"]
    with pytest.raises(AnalysisException):
        run_ingest(spark, work, *sink)
    assert not os.path.exists(f"{work}/ingest")
    spark.read.parquet(f"{work}/topic").limit(0).transform(read_posts).write.parquet(f"{work}/out")
    run_ingest(spark, work, *sink)
    assert_all(spark, spark.read.parquet(f"{work}/out"))
