"""Messages to a topic."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from feedlift.files import exists, files_in, folders_in, make_folder
from feedlift.schema import ENVELOPE_TYPES
from feedlift.sinks.table import WriteBatch, append_to
from feedlift.sinks.topic_log import has_log, log_of, write_logged
from feedlift.sources.named import NamedStream, Stream
from feedlift.streaming.batches import batch_writer
from feedlift.streaming.run import Trigger, start_batches, with_trigger

# What a broker would assign to a message; a topic kept as files needs it given.
PLACE = ("partition", "offset", "timestamp")


def kafka_sink_options(servers: str, topic: str, **options: object) -> dict[str, str]:
    """Options for writing to ``format("kafka")``; any other of Kafka's may be given."""
    chosen = {"kafka.bootstrap.servers": servers, "topic": topic, **options}
    return {name: str(value) for name, value in chosen.items()}


def _columns(messages: DataFrame, fmt: str) -> DataFrame:
    """A broker places unkeyed values itself; files must hold the whole envelope."""
    return messages.select("value" if fmt == "kafka" else "*")


def write_topic(
    messages: DataFrame, fmt: str = "kafka", options: Mapping[str, object] | None = None
) -> None:
    """Append a batch of messages.  A message that cannot be delivered fails the job.

    Into a topic of files that has a log, the batch goes as a stream of its own.
    """
    options = dict(options or {})
    if fmt != "kafka" and has_log(messages.sparkSession, str(options["path"])):
        write_logged(str(options.pop("path")), fmt, **options)(messages, uuid.uuid4().hex, 0)
        return
    writer = _columns(messages, fmt).write.format(fmt).options(**dict(options or {}))
    writer.mode("append").save()


def stream_topic(
    messages: Stream,
    checkpoint: str,
    fmt: str = "kafka",
    options: Mapping[str, object] | None = None,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Append messages as they come; a restart goes on after the last finished batch.

    A topic kept as files has a log, whoever writes to it: several streams may share it, and
    a batch that is written again changes nothing.  A stream of names is sent batch by batch.
    """
    options = dict(options or {})
    if fmt != "kafka":
        writer = batch_writer(to_file_topic(messages, fmt, options))
        return start_batches(messages, writer, checkpoint, trigger)
    if isinstance(messages, NamedStream):
        sent = messages.transform(_columns, fmt)
        return start_batches(sent, batch_writer(append_to(fmt, **options)), checkpoint, trigger)
    writer = _columns(messages, fmt).writeStream.format(fmt).options(**options)
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint)
    return with_trigger(writer, trigger).start()


def to_file_topic(messages: Stream, fmt: str, options: Mapping[str, object]) -> WriteBatch:
    """A batch writer into a topic kept as files, whose log is begun if there is none.

    A folder with files that no log names, or that Spark's own file sink has a log of, is
    refused: readers would see only what the topic's log names.
    """
    rest = dict(options)
    path, spark = str(rest.pop("path")), messages.sparkSession
    if exists(spark, f"{path}/_spark_metadata"):
        raise ValueError(f"{path} holds the log of a file sink; use another folder for the topic")
    if not has_log(spark, path):
        if exists(spark, path) and (files_in(spark, path) or folders_in(spark, path)):
            raise ValueError(f"{path} holds files without a topic's log; use another folder")
        make_folder(spark, log_of(path))
    return write_logged(path, fmt, **rest)


def place_as_files(messages: DataFrame, topic: str) -> DataFrame:
    """Messages in the full envelope, for a topic kept as files.

    The columns of ``PLACE`` must be among those of ``messages``; the key is
    NULL, as for any message sent without one.
    """
    return messages.selectExpr(
        "CAST(NULL AS BINARY) AS key",
        "value",
        f"'{topic}' AS topic",
        "partition",
        "offset",
        "timestamp",
        "0 AS timestampType",
    ).select(list(ENVELOPE_TYPES))
