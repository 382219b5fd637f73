"""Registered queries on delivery: what is replayed, lost, repeated or found comes out right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlift.files import make_folder
from feedlift.jobs import publish
from feedlift.operators.messages import read_posts
from feedlift.functions.epoch import utc_to_epoch
from feedlift.operators.offsets import PARTITION
from feedlift.operators.placement import Measured
from feedlift.plans.feeds import FEEDS, PARTITIONS, events_feed
from feedlift.schema import TARGET_COLUMNS, TARGET_TYPES, ddl, target_read_types
from feedlift.session import fresh_folder
from feedlift.sinks.merge import merge_into
from feedlift.sinks.table import BATCH, RUN, WriteBatch, append_to, replace_in_folder
from feedlift.sinks.topic import PLACE, place_as_files, to_file_topic, write_topic
from feedlift.sources.topic import read_topic
from feedlift.streaming.audit import audited, audited_gaps, read_folder_batch
from feedlift.streaming.batches import batch_writer
from feedlift.streaming.dedup import take_once
from feedlift.streaming.lag import distributions, with_lags
from feedlift.streaming.ingest import posts_to_messages, start_table_ingest
from feedlift.streaming.recover import resume_behind
from feedlift.streaming.run import ALL_NOW, drain


def _envelope(raw: DataFrame) -> DataFrame:
    return place_as_files(posts_to_messages(raw, PLACE), "posts")


def _target(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ddl(target_read_types())).parquet(path).select(TARGET_COLUMNS)


def _tasks(rows: DataFrame) -> int:
    """Tasks that rows read straight from a table are dealt to: by its size, none gets it whole."""
    return rows.rdd.getNumPartitions()


def _pieces(rows: DataFrame, batches: int) -> int:
    """Files for ``batches`` batches of equally many, each about what a task reads of the table."""
    return batches * -(-_tasks(rows) // batches)


def _send_in_batches(messages: DataFrame, options: dict[str, object], batches: int) -> None:
    """Writes a topic by many tasks, and bounds its ``options`` to be read in some batches."""
    pieces = _pieces(messages, batches)
    write_topic(messages.repartition(pieces), "parquet", options)
    options["maxFilesPerTrigger"] = pieces // batches


def _number() -> Column:
    return F.col("offset") * PARTITIONS + F.col("partition")


def _until_done(run: Callable[[], object], most: int = 5) -> None:
    """Starts a job again as often as it is lost."""
    for _ in range(most):
        try:
            run()
            return
        except StreamingQueryException:
            continue
    run()


def topic_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers lost before and behind their entry in the log, with a reader running between.

    Events: all data and the entry are there, the batch is not committed.  Documents: the data
    are there, the entry is not.  Both run again; the reader takes each message once.
    """
    work = fresh_folder(spark, "replay")
    path = f"{work}/topic"

    def ingest() -> None:
        rows = read_topic(spark, "parquet", {"path": path}).transform(read_posts)
        drain(rows, batch_writer(replace_in_folder(f"{work}/out")), f"{work}/ingest")

    for feed, behind in (("events", True), ("documents", False)):
        messages = _envelope(FEEDS[feed](spark, sf_dir, stream=True))
        write = to_file_topic(messages, "parquet", {"path": path})
        writer = batch_writer(write)

        def lost(batch: DataFrame, number: int, writer=writer, behind=behind) -> None:
            if behind:
                writer(batch, number)
            else:
                batch.write.parquet(f"{path}/topic-data/lost/{number}")
            raise RuntimeError("driver lost before the commit")

        attempts = iter([lost])

        def publish_again(messages=messages, writer=writer, attempts=attempts, feed=feed) -> None:
            drain(messages, next(attempts, writer), f"{work}/publish-{feed}")
            ingest()

        try:
            publish_again()
        except StreamingQueryException:
            ingest()
        publish_again()
    return _target(spark, f"{work}/out")


def feed_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that is empty at first and then gets files of INT, BIGINT and DOUBLE counts."""
    work = fresh_folder(spark, "mixed")
    feed = f"{work}/feed"
    arguments = publish.parse([
        "--feed", feed, "--topic-format", "parquet", "--topic-option", f"path={work}/topic",
        "--checkpoint", f"{work}/checkpoint", "--all-now", "--include-existing",
    ])
    make_folder(spark, feed)
    publish.start(spark, arguments).awaitTermination()
    beyond = F.lit(3_000_000_000)
    kinds = {
        0: {"score": F.col("score").cast("int"), "num_comments": F.col("num_comments").cast("int")},
        1: {
            "score": F.col("score").cast("bigint") + beyond,
            "num_comments": F.col("num_comments").cast("bigint") - beyond,
        },
        2: {"score": F.col("score") + 0.0, "num_comments": F.col("num_comments") + 0.75},
    }
    for kind, counts in kinds.items():
        rows = events_feed(spark, sf_dir).where(_number() % 3 == kind).withColumns(counts)
        rows.repartition(_pieces(rows, 2)).write.mode("append").parquet(feed)
    publish.start(spark, arguments).awaitTermination()
    sent = read_topic(spark, "parquet", {"path": f"{work}/topic"}, stream=False)
    names = ("id", "score", "num_comments")
    fields = sent.select(F.json_tuple(F.col("value").cast("string"), *names).alias(*names))
    return fields.withColumns({name: F.col(name).cast("bigint") for name in names[1:]})


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic that holds many messages twice and some three times, read in several batches."""
    work = fresh_folder(spark, "dedup")
    options = {"path": f"{work}/topic"}
    messages = _envelope(events_feed(spark, sf_dir))
    for again in (F.lit(True), _number() % 2 == 0, _number() % 3 == 0):
        write_topic(messages.where(again), "parquet", options)
    bound = {"maxFilesPerTrigger": -(-_tasks(messages) // 2)}
    topic = read_topic(spark, "parquet", options | bound)
    rows = topic.transform(take_once).transform(read_posts)
    drain(rows, batch_writer(replace_in_folder(f"{work}/out")), f"{work}/checkpoint")
    return _target(spark, f"{work}/out")


def sink_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that only appends, and a job lost after staging, while appending, and behind it."""
    work = fresh_folder(spark, "merge")
    options, out = {"path": f"{work}/topic"}, f"{work}/out"
    feeds = [_envelope(FEEDS[feed](spark, sf_dir)) for feed in ("events", "pages")]
    for messages in feeds:
        write_topic(messages, "parquet", options)
    # About a feed in a batch, however many files it has.
    options["maxFilesPerTrigger"] = max(map(_tasks, feeds))
    append = append_to("parquet", path=out)
    losses = iter(("staged", "half", "appended", "staged"))

    def losing(batch: DataFrame, run: str, number: int) -> None:
        at = next(losses, None)
        if at != "staged":
            half = F.col("kafka_offset") % 2 == 0
            append(batch.where(half) if at == "half" else batch, run, number)
        if at:
            raise RuntimeError(f"driver lost: {at}")

    def read_sink(here: SparkSession) -> DataFrame:
        return here.read.schema(ddl(target_read_types())).parquet(out)

    def ingest() -> None:
        # One topic for each feed's places, or those of the other would be taken for them.
        topic = read_topic(spark, "parquet", options)
        rows = topic.transform(read_posts)
        writer = batch_writer(merge_into(losing, read_sink, f"{work}/staging", _MERGE_KEY))
        drain(rows, writer, f"{work}/checkpoint")

    _until_done(ingest)
    return read_sink(spark).select(TARGET_COLUMNS)


# Two feeds share the topic's places in this query; the post's id tells them apart.
_MERGE_KEY = ("id", PARTITION, "kafka_offset")


def resume_without_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that has some of a topic, with gaps, and a stream without its checkpoint."""
    work = fresh_folder(spark, "recover")
    options, out = {"path": f"{work}/topic"}, f"{work}/out"
    messages = _envelope(events_feed(spark, sf_dir))
    _send_in_batches(messages, options, 4)
    came = (_number() % 5 != 0) & (F.col("offset") % 40 < 25)
    before = messages.where(came).transform(read_posts)
    replace_in_folder(out)(before, "lost", 0)
    for _ in range(2):
        topic = read_topic(spark, "parquet", options)
        rest = resume_behind(topic, _target(spark, out), f"{work}/checkpoint")
        drain(
            rest.transform(read_posts), batch_writer(replace_in_folder(out)), f"{work}/checkpoint"
        )
    return _target(spark, out)


def offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What never came of a topic, found batch by batch while it is ingested out of order."""
    work = fresh_folder(spark, "gaps")
    options, out, audit = {"path": f"{work}/topic"}, f"{work}/out", f"{work}/audit"
    there = (_number() % 50 >= 9) & (_number() % 331 != 0)
    messages = _envelope(events_feed(spark, sf_dir)).where(there)
    _send_in_batches(messages, options, 4)
    write: WriteBatch = audited(replace_in_folder(out), audit, read_folder_batch(out))
    topic = read_topic(spark, "parquet", options)
    drain(topic.transform(read_posts), batch_writer(write), f"{work}/checkpoint")
    return audited_gaps(spark, audit)


def sink_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of an older target, its columns in another order, made to fit and written to."""
    work = fresh_folder(spark, "evolve")
    name, location = "posts_" + work.rsplit("-", 1)[1], f"{work}/data"
    since = ("url", "selftext", "kafka_timestamp")
    older = {c: t for c, t in target_read_types().items() if c not in since}
    older = dict(sorted(older.items())) | {"score": "BIGINT", "note": "STRING"}
    spark.sql(
        f"CREATE TABLE {name} ({ddl(older)}, {RUN} STRING, {BATCH} BIGINT) USING parquet "
        f"PARTITIONED BY ({RUN}, {BATCH}) LOCATION '{location}'"
    )
    rows = _envelope(FEEDS["documents"](spark, sf_dir)).transform(read_posts)
    rows = rows.drop(*since).withColumn("note", F.lit("older"))
    spark.sql(
        f"INSERT INTO {name} PARTITION ({RUN} = 'older', {BATCH} = 0) BY NAME "
        f"SELECT {', '.join(older)} FROM {{rows}}",
        rows=rows,
    )
    envelope = _envelope(events_feed(spark, sf_dir, stream=True))
    start_table_ingest(
        spark, envelope, name, f"{work}/checkpoint", location=location, trigger=ALL_NOW
    ).awaitTermination()
    types = target_read_types() | {"score": "BIGINT", "note": "STRING", RUN: "STRING"}
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(ddl(types)).parquet(location).select(*TARGET_TYPES, "note")


_PLACES = 24


def _skewed(rows: DataFrame) -> DataFrame:
    """A key with a third of all rows, no key for more than half, and fifty light ones."""
    light = F.concat(F.lit("k"), (F.col("kafka_offset") % 50).cast("string"))
    light = F.when(F.col("kafka_offset") % 7 == 0, light)
    return rows.withColumn("key", F.when(F.col("kafka_offset") % 3 == 0, "hot").otherwise(light))


def placement_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of skewed keys placed by the sizes that the reading before was measured by.

    ``n_split`` counts light keys that are in several partitions; of the row for ``all``, those
    partitions that have more than twice the mean.
    """
    work = fresh_folder(spark, "skew")
    options = {"path": f"{work}/topic"}
    for feed in ("events", "documents", "pages"):
        write_topic(_envelope(FEEDS[feed](spark, sf_dir)), "parquet", options)
    # In one batch: the second reading is placed by the measures of all the first.
    topic = read_topic(spark, "parquet", options | {"maxBytesPerTrigger": None})
    spread = Measured("key", _PLACES)
    for name in ("before", "measured"):
        placed = replace_in_folder(f"{work}/{name}")

        def write(batch: DataFrame, run: str, number: int, placed: WriteBatch = placed) -> None:
            placed(batch.select("key", F.spark_partition_id().alias("place")), run, number)

        rows = topic.transform(read_posts).transform(_skewed)
        drain(rows, batch_writer(write, spread), f"{work}/checkpoint-{name}")
    rows = spark.read.parquet(f"{work}/measured")
    large = F.col("n") > 2 * rows.count() / _PLACES
    sizes = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("n_rows"), F.count_if(large).alias("n_split"))
    kind = F.when(F.col("key").isNull() | (F.col("key") == "hot"), F.col("key")).otherwise("light")
    keys = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("place").alias("places")
    )
    kinds = keys.groupBy(kind.alias("key")).agg(
        F.sum("n_rows").alias("n_rows"),
        F.count_if((F.col("key") != "hot") & (F.col("places") > 1)).alias("n_split"),
    )
    return kinds.unionByName(whole.withColumn("key", F.lit("all")))


def ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags and sizes by community from sketches of several batches, held against all rows.

    ``n_lag_off`` and ``n_size_off`` count quantiles whose rank is off by more than five percent.
    """
    work = fresh_folder(spark, "lag")
    options, out, lags = {"path": f"{work}/topic"}, f"{work}/out", f"{work}/lags"
    _send_in_batches(_envelope(FEEDS["documents"](spark, sf_dir)), options, 4)
    write = with_lags(replace_in_folder(out), lags, read_folder_batch(out))
    topic = read_topic(spark, "parquet", options)
    drain(topic.transform(read_posts), batch_writer(write), f"{work}/checkpoint")
    quantiles = (0.1, 0.5, 0.9)
    found = distributions(spark, lags, quantiles).select(
        "subreddit", F.col("lag").alias("lags"), F.col("size").alias("sizes"), "n_rows"
    )
    rows = _target(spark, out).select(
        "subreddit",
        (utc_to_epoch(F.col("kafka_timestamp")) - utc_to_epoch(F.col("created_utc"))).alias("lag"),
        (F.octet_length("title") + F.octet_length("selftext")).cast("bigint").alias("size"),
    )
    held = rows.join(found, "subreddit").groupBy("subreddit", "n_rows")
    ranks = {}
    for name in ("lag", "size"):
        for number, q in enumerate(quantiles):
            value = F.col(f"{name}s")[number]
            below, upto = F.avg((F.col(name) < value).cast("int")), F.avg(
                (F.col(name) <= value).cast("int")
            )
            ranks[name, number] = ((below > q + 0.05) | (upto < q - 0.05)).cast("bigint")
    return held.agg(
        *(
            sum(ranks[name, number] for number in range(len(quantiles))).alias(f"n_{name}_off")
            for name in ("lag", "size")
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topic_replay": topic_replay,
    "feed_mixed_types": feed_mixed_types,
    "stream_dedup": stream_dedup,
    "sink_merge": sink_merge,
    "resume_without_checkpoint": resume_without_checkpoint,
    "offset_gaps": offset_gaps,
    "sink_evolve": sink_evolve,
    "placement_skewed": placement_skewed,
    "ingest_lag": ingest_lag,
}
