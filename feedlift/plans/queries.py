"""The registered queries.

Each takes a session and a folder of tables, works on whole tables, and returns
a DataFrame.  Queries that write do so below the folder the session shares, in
a new place per call, and return what a reader of the target then sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlift.functions.epoch import (
    epoch_to_string,
    epoch_to_timestamp,
    instant_to_utc,
    utc_to_epoch,
)
from feedlift.jobs import publish
from feedlift.operators.messages import (
    decode_messages,
    encode_messages,
    read_posts,
    with_lineage,
)
from feedlift.operators.normalize import flag_unusable, normalize_posts
from feedlift.operators.placement import by_key, rebalance, salt, salts_for
from feedlift.plans.delivery import QUERIES as DELIVERY
from feedlift.plans.feeds import FEEDS, PARTITIONS, events_feed, table
from feedlift.schema import TARGET_COLUMNS, WIRE_COLUMNS, WIRE_TYPES, ddl, target_read_types
from feedlift.session import fresh_folder
from feedlift.sinks.table import (
    BATCH,
    RUN,
    append_to,
    append_to_table,
    ensure_table,
    replace_in_folder,
)
from feedlift.sinks.topic import PLACE, place_as_files, stream_topic, to_file_topic, write_topic
from feedlift.sources.topic import read_topic
from feedlift.streaming.batches import batch_writer
from feedlift.streaming.ingest import (
    posts_to_messages,
    start_folder_ingest,
    start_ingest,
    start_publish,
    start_table_ingest,
)
from feedlift.streaming.run import ALL_NOW, drain, skip_existing

Query = Callable[[SparkSession, str], DataFrame]
TOPIC = "posts"
BATCH_FILES = 2


# --- shared steps ---------------------------------------------------------


def _envelope(raw: DataFrame) -> DataFrame:
    """Raw posts as the messages a topic would hold."""
    return place_as_files(posts_to_messages(raw, PLACE), TOPIC)


def _publish(spark: SparkSession, sf_dir: str, path: str, *feeds: str) -> None:
    """Append whole feeds to a topic kept as files."""
    for feed in feeds:
        write_topic(_envelope(FEEDS[feed](spark, sf_dir)), "parquet", {"path": path})


def _topic(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_topic(spark, "parquet", {"path": path, **options})


def _ingest(topic: DataFrame, out: str, checkpoint: str) -> None:
    """Run the ingest job to the end of what the topic holds now."""
    query = start_ingest(topic, checkpoint, replace_in_folder(out), trigger=ALL_NOW)
    query.awaitTermination()


def _ingested(spark: SparkSession, out: str) -> DataFrame:
    """Target rows and the number of the batch each came with."""
    rows = spark.read.schema(ddl(target_read_types() | {BATCH: "INT"})).parquet(out)
    return rows.select(*TARGET_COLUMNS, BATCH)


# --- feed to messages -----------------------------------------------------


def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed(spark, sf_dir).transform(normalize_posts)


def _with_gaps(raw: DataFrame) -> DataFrame:
    """Posts some of which lack a required number."""
    number = F.col("offset") * PARTITIONS + F.col("partition")
    nan = F.lit(float("nan"))
    return raw.withColumns(
        {
            "score": F.when(number % 13 != 0, F.col("score")),
            "num_comments": F.when(number % 19 == 0, nan).otherwise(F.col("num_comments")),
            "upvote_ratio": F.when(number % 23 != 0, F.col("upvote_ratio")),
            "created_utc": F.when(number % 17 != 0, F.col("created_utc")),
        }
    )


def normalize_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which posts have no wire record, and which numbers they lack."""
    flagged = events_feed(spark, sf_dir).transform(_with_gaps).transform(flag_unusable)
    return flagged.select("id", "reject_reason")


def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message bytes, the fields read back from the text as they stand there."""
    values = events_feed(spark, sf_dir).transform(posts_to_messages)
    text = F.col("value").cast("string")
    fields = values.select(F.json_tuple(text, *WIRE_TYPES).alias(*WIRE_TYPES))
    return fields.select(*(F.col(name).cast(kind).alias(name) for name, kind in WIRE_TYPES.items()))


def json_encode_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in four languages as ASCII-only messages, and what they decode to."""
    wire = FEEDS["documents"](spark, sf_dir).transform(normalize_posts)
    decoded = wire.transform(encode_messages, ascii_only=True).transform(decode_messages)
    wide = F.octet_length("value") - F.char_length(F.col("value").cast("string"))
    return decoded.select("json.id", "json.selftext", wide.cast("int").alias("wide_bytes"))


def _envelope_columns(topic: DataFrame) -> DataFrame:
    """All of an envelope but its value, which is compared decoded elsewhere."""
    return topic.select(
        F.col("key").cast("string").alias("key"),
        "topic",
        "partition",
        "offset",
        instant_to_utc(F.col("timestamp")).alias("timestamp"),
        "timestampType",
        F.col("value").isNotNull().cast("int").alias("has_value"),
    )


def topic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages appended to a topic, and the envelope it then holds."""
    path = fresh_folder(spark, "topic")
    _publish(spark, sf_dir, path, "events")
    return _envelope_columns(read_topic(spark, "parquet", {"path": path}, stream=False))


def topic_publish_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed streamed into a topic, and the topic's posts."""
    work = fresh_folder(spark, "publish")
    messages = _envelope(events_feed(spark, sf_dir, stream=True))
    stream_topic(
        messages, f"{work}/checkpoint", "parquet", {"path": f"{work}/topic"}, ALL_NOW
    ).awaitTermination()
    topic = read_topic(spark, "parquet", {"path": f"{work}/topic"}, stream=False)
    return topic.transform(read_posts)


def topic_publish_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with gaps streamed into a topic, posts without a wire record aside, whole."""
    work = fresh_folder(spark, "publish")
    raw = events_feed(spark, sf_dir, stream=True).transform(_with_gaps)
    start_publish(
        raw,
        f"{work}/checkpoint",
        replace_in_folder(f"{work}/topic"),
        replace_in_folder(f"{work}/rejects"),
        to_messages=_envelope,
        trigger=ALL_NOW,
    ).awaitTermination()
    sent = spark.read.parquet(f"{work}/topic").transform(with_lineage).transform(decode_messages)
    aside = spark.read.parquet(f"{work}/rejects")
    comments = F.when(~F.isnan("num_comments"), F.col("num_comments"))
    return sent.select("json.*", F.lit("sent").alias("outcome")).unionByName(
        aside.withColumn("num_comments", comments).select(
            *WIRE_COLUMNS, F.col("reject_reason").alias("outcome")
        )
    )


def topic_publish_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one topic, one of them with rejects: readers see all of both."""
    work = fresh_folder(spark, "publish")
    options = {"path": f"{work}/topic"}
    events = _envelope(events_feed(spark, sf_dir, stream=True))
    stream_topic(events, f"{work}/one", "parquet", options, ALL_NOW).awaitTermination()
    documents = FEEDS["documents"](spark, sf_dir, stream=True)
    start_publish(
        documents,
        f"{work}/two",
        to_file_topic(documents, "parquet", options),
        replace_in_folder(f"{work}/rejects"),
        to_messages=_envelope,
        trigger=ALL_NOW,
    ).awaitTermination()
    return read_topic(spark, "parquet", options, stream=False).transform(read_posts)


def normalize_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed whose counts are BIGINT, some beyond INT, through the publish job."""
    work = fresh_folder(spark, "publish")
    beyond = F.when(_number() % 7 == 0, F.lit(3_000_000_000)).otherwise(F.lit(0))
    counts = {
        "score": F.col("score").cast("bigint") + beyond,
        "num_comments": F.col("num_comments").cast("bigint") - beyond,
    }
    events_feed(spark, sf_dir).withColumns(counts).write.parquet(f"{work}/feed")
    arguments = publish.parse([
        "--feed", f"{work}/feed", "--topic-format", "parquet", "--topic-option",
        f"path={work}/topic", "--checkpoint", f"{work}/checkpoint", "--all-now",
        "--include-existing",
    ])
    publish.start(spark, arguments).awaitTermination()
    sent = read_topic(spark, "parquet", {"path": f"{work}/topic"}, stream=False)
    names = ("id", "score", "num_comments")
    fields = sent.select(F.json_tuple(F.col("value").cast("string"), *names).alias(*names))
    return fields.withColumns({name: F.col(name).cast("bigint") for name in names[1:]})


# --- messages to rows -----------------------------------------------------


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events_feed(spark, sf_dir)
        .transform(posts_to_messages)
        .transform(decode_messages)
        .select("json.*")
    )


def json_decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages, some of which hold bytes that are not UTF-8 behind their id."""
    messages = _envelope(events_feed(spark, sf_dir))
    text = F.col("value").cast("string")
    head = F.instr(text, '","title"') - 1
    stray = F.when(_number() % 4 == 0, F.expr("X'FFFE'")).otherwise(F.expr("X''"))
    value = F.concat(
        F.substring(text, F.lit(1), head).cast("binary"),
        stray,
        text.substr(head + 1, F.char_length(text)).cast("binary"),
    )
    return messages.withColumn("value", value).transform(decode_messages).select("json.*")


def _number() -> Column:
    return F.col("offset") * PARTITIONS + F.col("partition")


def _damage(envelope: DataFrame) -> DataFrame:
    """Messages eleven in twelve of which are not quite what was declared."""
    text = F.col("value").cast("string")
    last = F.char_length(text) - 1
    damaged = {
        0: F.substring(text, 1, 30),
        1: F.regexp_replace(text, '"score":(-?[0-9]+)', '"score":"$1"'),
        2: F.lit(""),
        3: F.lit(None).cast("string"),
        4: F.concat(F.lit("["), text, F.lit(","), text, F.lit("]")),
        5: F.concat(F.lit('{"zzz":1,'), text.substr(F.lit(2), last)),
        6: F.concat(text.substr(F.lit(1), last), F.lit(',"id":"again"}')),
        7: F.replace(text, F.lit('"id":'), F.lit('"ID":')),
        8: F.regexp_replace(text, '"score":(-?[0-9]+)', '"score":$1.0'),
        9: F.concat(text.substr(F.lit(1), last), F.lit(f',"title":"{"x" * 1025}"}}')),
        10: F.concat(text, F.lit(" junk")),
    }
    kind = _number() % 12
    value = F.when(kind == 11, F.lit("hello"))
    for which, changed in damaged.items():
        value = value.when(kind == which, changed)
    return envelope.withColumn("value", value.cast("binary"))


def json_decode_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged messages all become rows, with NULLs where nothing can be read."""
    damaged = _envelope(events_feed(spark, sf_dir)).transform(_damage)
    return damaged.transform(read_posts)


def flatten_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain in one narrow stage: post, message, typed row."""
    return _envelope(events_feed(spark, sf_dir)).transform(read_posts)


def _roundtrip(feed: str) -> Query:
    return lambda spark, sf_dir: _envelope(FEEDS[feed](spark, sf_dir)).transform(read_posts)


def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _envelope(events_feed(spark, sf_dir)).transform(with_lineage)
    return rows.select(
        F.get_json_object(F.col("value").cast("string"), "$.id").alias("id"),
        instant_to_utc(F.col("kafka_timestamp")).alias("kafka_timestamp"),
        "kafka_partition",
        "kafka_offset",
    )


def epoch_string_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = events_feed(spark, sf_dir)
    return raw.select("id", epoch_to_string(F.col("created_utc")).alias("created_text"))


def epoch_timestamp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = events_feed(spark, sf_dir)
    return raw.select("id", epoch_to_timestamp(F.col("created_utc")).alias("created_utc"))


def epoch_shipdates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conversions over the largest table."""
    seconds = utc_to_epoch(F.col("l_shipdate")) + F.col("l_linenumber") * 0.75
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        epoch_to_timestamp(seconds).alias("shipped_utc"),
        epoch_to_string(seconds).alias("shipped_text"),
    )


# --- streams --------------------------------------------------------------


def src_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed scanned as a stream, all columns as they are."""
    work = fresh_folder(spark, "scan")
    feed = table(spark, sf_dir, "events", stream=True)
    drain(feed, batch_writer(replace_in_folder(f"{work}/out")), f"{work}/checkpoint")
    return spark.read.schema(feed.schema).parquet(f"{work}/out").select(feed.columns)


def src_topic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic scanned as a stream, its envelope as it is."""
    work = fresh_folder(spark, "scan")
    _publish(spark, sf_dir, f"{work}/topic", "events")
    topic = _topic(spark, f"{work}/topic")
    drain(topic, batch_writer(replace_in_folder(f"{work}/out")), f"{work}/checkpoint")
    return _envelope_columns(spark.read.schema(topic.schema).parquet(f"{work}/out"))


def src_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a topic held before the first start is skipped, what follows is not."""
    work = fresh_folder(spark, "latest")
    path, checkpoint = f"{work}/topic", f"{work}/checkpoint"
    _publish(spark, sf_dir, path, "events")
    skip_existing(_topic(spark, path, maxBytesPerTrigger=None).transform(read_posts), checkpoint)
    _publish(spark, sf_dir, path, "documents")
    _ingest(_topic(spark, path), f"{work}/out", checkpoint)
    return _ingested(spark, f"{work}/out").drop(BATCH)


def src_skip_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing there at the first start, a first batch that fails, a restart: nothing is lost."""
    work = fresh_folder(spark, "latest")
    path, checkpoint = f"{work}/topic", f"{work}/checkpoint"
    # Partitioned, so that no rows leave no files.
    nothing = _envelope(events_feed(spark, sf_dir)).where(F.lit(False))
    nothing.write.partitionBy("topic").parquet(path)
    rows = _topic(spark, path, maxBytesPerTrigger=None).transform(read_posts)

    def lost(batch: DataFrame, number: int) -> None:
        raise RuntimeError("lost before the write")

    skip_existing(rows, checkpoint)
    _publish(spark, sf_dir, path, "events")
    try:
        drain(rows, lost, checkpoint)
    except StreamingQueryException:
        skip_existing(rows, checkpoint)
    _ingest(_topic(spark, path), f"{work}/out", checkpoint)
    return _ingested(spark, f"{work}/out").drop(BATCH)


def stream_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed, message and typed row in one stream, written batch by batch."""
    work = fresh_folder(spark, "ingest")
    envelope = _envelope(events_feed(spark, sf_dir, stream=True))
    _ingest(envelope, f"{work}/out", f"{work}/checkpoint")
    return _ingested(spark, f"{work}/out").drop(BATCH)


def stream_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four feeds in one topic, taken in several batches of at most so many files each."""
    work = fresh_folder(spark, "batches")
    path = f"{work}/topic"
    _publish(spark, sf_dir, path, *FEEDS)
    topic = _topic(spark, path, maxFilesPerTrigger=BATCH_FILES)
    _ingest(topic, f"{work}/out", f"{work}/checkpoint")
    return _ingested(spark, f"{work}/out").drop(BATCH)


def stream_empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose rows are all filtered out, then a whole feed: rows per batch."""
    work = fresh_folder(spark, "empty")
    path, checkpoint = f"{work}/topic", f"{work}/checkpoint"
    writer = batch_writer(replace_in_folder(f"{work}/out"), skip_empty=True)
    _publish(spark, sf_dir, path, "documents")
    whole = _topic(spark, path, maxBytesPerTrigger=None)
    drain(whole.where(F.col("topic") != TOPIC).transform(read_posts), writer, checkpoint)
    _publish(spark, sf_dir, path, "events")
    drain(whole.transform(read_posts), writer, checkpoint)
    rows = _ingested(spark, f"{work}/out")
    return rows.groupBy(F.col(BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"))


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a growing topic: the second goes on where the first ended."""
    work = fresh_folder(spark, "resume")
    for feed in ("events", "documents"):
        _publish(spark, sf_dir, f"{work}/topic", feed)
        _ingest(_topic(spark, f"{work}/topic"), f"{work}/out", f"{work}/checkpoint")
    return _ingested(spark, f"{work}/out").drop(BATCH)


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job lost after its write and before its commit: the rerun replaces the batch."""
    work = fresh_folder(spark, "replay")
    writer = batch_writer(replace_in_folder(f"{work}/out"))

    def lost_after_write(batch: DataFrame, number: int) -> None:
        writer(batch, number)
        raise RuntimeError("driver lost after the write")

    rows = _envelope(events_feed(spark, sf_dir, stream=True)).transform(read_posts)
    try:
        drain(rows, lost_after_write, f"{work}/checkpoint")
    except StreamingQueryException:
        drain(rows, writer, f"{work}/checkpoint")
    return _ingested(spark, f"{work}/out").drop(BATCH)


def _with_outcomes(good: DataFrame, aside: DataFrame, envelope: DataFrame) -> DataFrame:
    """Rows and rejects, whole, and whether each reject has its message as it came."""
    came = envelope.select(
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("value").alias("came"),
    )
    aside = aside.join(came, ["kafka_partition", "kafka_offset"])
    kept = F.col("raw_value").eqNullSafe(F.col("came")).cast("int")
    rejects = aside.select(
        *TARGET_COLUMNS, F.col("reject_reason").alias("outcome"), kept.alias("raw_kept")
    )
    rows = good.select(
        *TARGET_COLUMNS, F.lit("ok").alias("outcome"), F.lit(None).cast("int").alias("raw_kept")
    )
    return rows.unionByName(rejects)


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged messages split into rows of the target and rejects with a reason."""
    work = fresh_folder(spark, "rejects")
    envelope = _envelope(events_feed(spark, sf_dir, stream=True)).transform(_damage)
    start_ingest(
        envelope,
        f"{work}/checkpoint",
        replace_in_folder(f"{work}/out"),
        replace_in_folder(f"{work}/rejects"),
        trigger=ALL_NOW,
    ).awaitTermination()
    sent = _envelope(events_feed(spark, sf_dir)).transform(_damage)
    aside = spark.read.parquet(f"{work}/rejects")
    return _with_outcomes(_ingested(spark, f"{work}/out"), aside, sent)


def stream_rejects_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes from one folder, written in one pass."""
    work = fresh_folder(spark, "rejects")
    envelope = _envelope(events_feed(spark, sf_dir, stream=True)).transform(_damage)
    start_folder_ingest(
        envelope, f"{work}/out", f"{work}/checkpoint", trigger=ALL_NOW
    ).awaitTermination()
    rows = spark.read.parquet(f"{work}/out")
    sent = _envelope(events_feed(spark, sf_dir)).transform(_damage)
    return _with_outcomes(rows.where("outcome = 'row'"), rows.where("outcome = 'reject'"), sent)


# --- the target table -----------------------------------------------------


def _table_name(work: str) -> str:
    return "posts_" + work.rsplit("-", 1)[1]


def _read_and_forget(spark: SparkSession, name: str, location: str) -> DataFrame:
    """The rows of a table at ``location``; the catalog does not keep it."""
    types = ddl(target_read_types() | {RUN: "STRING", BATCH: "BIGINT"})
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(types).parquet(location).select(TARGET_COLUMNS)


def stream_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles longer than the target's bound through the table job as it is: all rows, uncut."""
    work = fresh_folder(spark, "table")
    name, location = _table_name(work), f"{work}/data"
    long = F.when(_number() % 10 == 0, F.repeat(F.lit("y"), F.lit(1100))).otherwise(F.col("title"))
    raw = events_feed(spark, sf_dir, stream=True).withColumn("title", long)
    start_table_ingest(
        spark, _envelope(raw), name, f"{work}/checkpoint", location=location, trigger=ALL_NOW
    ).awaitTermination()
    return _read_and_forget(spark, name, location)


def sink_ensure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made before the stream starts, and again harmlessly by a restart."""
    work = fresh_folder(spark, "table")
    name, location = _table_name(work), f"{work}/data"
    for _ in range(2):
        envelope = _envelope(events_feed(spark, sf_dir, stream=True))
        start_table_ingest(
            spark, envelope, name, f"{work}/checkpoint", location=location, trigger=ALL_NOW
        ).awaitTermination()
    return _read_and_forget(spark, name, location)


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one table; both stay."""
    work = fresh_folder(spark, "append")
    name = _table_name(work)
    ensure_table(spark, name, location=f"{work}/data")
    write = append_to_table(name)
    for number, feed in enumerate(("events", "conversations")):
        write(_envelope(FEEDS[feed](spark, sf_dir)).transform(read_posts), "batch", number)
    return _read_and_forget(spark, name, f"{work}/data")


def sink_append_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a data source chosen by its name and options."""
    work = fresh_folder(spark, "append")
    write = append_to("orc", path=f"{work}/data", compression="zstd")
    for number, feed in enumerate(("events", "pages")):
        write(_envelope(FEEDS[feed](spark, sf_dir)).transform(read_posts), "batch", number)
    return spark.read.schema(ddl(target_read_types())).orc(f"{work}/data")


def batch_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each batch, as its write observed them and as the target tells them."""
    work = fresh_folder(spark, "counts")
    observed: list[tuple[int, int]] = []
    writer = batch_writer(
        replace_in_folder(f"{work}/out"), on_count=lambda *count: observed.append(count)
    )
    for feed in ("events", "documents"):
        _publish(spark, sf_dir, f"{work}/topic", feed)
        whole = _topic(spark, f"{work}/topic", maxBytesPerTrigger=None)
        drain(whole.transform(read_posts), writer, f"{work}/checkpoint")
    rows = _ingested(spark, f"{work}/out").groupBy(F.col(BATCH).alias("batch"))
    counts = spark.createDataFrame(observed, "batch INT, n_observed BIGINT")
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).join(counts, "batch", "full")


# --- placement ------------------------------------------------------------


def _places(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rows by ``keys`` and the partition they are in, counted there and written down.

    What is read again has no partitioning that a later grouping could rely on.
    """
    path = fresh_folder(rows.sparkSession, "places")
    placed = rows.select(*keys, F.spark_partition_id().alias("place"))
    placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def repartition_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows placed by community: in salted pieces, and whole in six partitions.

    ``n_split`` counts pieces that are in several partitions, ``n_places`` the
    partitions of a community without salts, ``n_outside`` those beyond the six.
    """
    rows = flatten_typed(spark, sf_dir)
    piece = salt(["kafka_partition", "kafka_offset"], salts_for(rows))
    salted = _places(rows.transform(by_key("subreddit")), F.col("subreddit"), piece.alias("piece"))
    pieces = salted.groupBy("subreddit", "piece").agg(
        F.sum("n").alias("n"), F.count_distinct("place").alias("places")
    )
    split = pieces.groupBy("subreddit").agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("places") > 1).alias("n_split")
    )
    fixed = _places(rows.transform(by_key("subreddit", 6, salts=1)), F.col("subreddit"))
    whole = fixed.groupBy("subreddit").agg(
        F.sum("n").alias("n_fixed"),
        F.count_distinct("place").alias("n_places"),
        F.count_if(F.col("place") >= 6).alias("n_outside"),
    )
    return split.join(whole, "subreddit")


def repartition_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write whose tasks adaptive execution sizes: no row is lost or doubled."""
    work = fresh_folder(spark, "rebalance")
    writer = batch_writer(replace_in_folder(f"{work}/out"), spread=rebalance("subreddit"))
    rows = _envelope(events_feed(spark, sf_dir, stream=True)).transform(read_posts)
    drain(rows, writer, f"{work}/checkpoint")
    return _ingested(spark, f"{work}/out").drop(BATCH)


QUERIES: dict[str, Query] = {
    "normalize_posts": normalize_query,
    "normalize_unusable": normalize_unusable,
    "json_encode": json_encode,
    "json_encode_ascii": json_encode_ascii,
    "json_decode": json_decode,
    "json_decode_bytes": json_decode_bytes,
    "json_decode_malformed": json_decode_malformed,
    "flatten_typed": flatten_typed,
    "roundtrip_documents": _roundtrip("documents"),
    "roundtrip_pages": _roundtrip("pages"),
    "roundtrip_conversations": _roundtrip("conversations"),
    "lineage_columns": lineage_columns,
    "epoch_to_string": epoch_string_query,
    "epoch_to_timestamp": epoch_timestamp_query,
    "epoch_shipdates": epoch_shipdates,
    "topic_envelope": topic_envelope,
    "topic_publish_stream": topic_publish_stream,
    "topic_publish_rejects": topic_publish_rejects,
    "topic_publish_mixed": topic_publish_mixed,
    "normalize_bigint": normalize_bigint,
    "src_stream_scan": src_stream_scan,
    "src_topic_scan": src_topic_scan,
    "src_skip_existing": src_skip_existing,
    "src_skip_restart": src_skip_restart,
    "stream_foreach_batch": stream_foreach_batch,
    "stream_micro_batches": stream_micro_batches,
    "stream_empty_batch": stream_empty_batch,
    "stream_resume": stream_resume,
    "stream_replay": stream_replay,
    "stream_rejects": stream_rejects,
    "stream_rejects_one_pass": stream_rejects_one_pass,
    "stream_long_text": stream_long_text,
    "sink_ensure_table": sink_ensure_table,
    "sink_append": sink_append,
    "sink_append_format": sink_append_format,
    "batch_row_counts": batch_row_counts,
    "repartition_by_key": repartition_by_key,
    "repartition_rebalanced": repartition_rebalanced,
} | DELIVERY
