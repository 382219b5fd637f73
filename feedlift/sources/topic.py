"""A topic of messages in Kafka's envelope."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from feedlift.schema import ENVELOPE_TYPES, ddl
from feedlift.sinks.topic_log import ENTRY_TYPES, has_log, log_of
from feedlift.sources.feed import read_feed
from feedlift.sources.named import NamedStream, Stream

# Unless told otherwise: skip what the topic held before the first start (after
# that the checkpoint decides), bound what one batch takes of a backlog (the
# rest waits for later batches), and split a topic partition that holds far
# more than the others over several tasks.
KAFKA_DEFAULTS = {
    "startingOffsets": "latest",
    "maxOffsetsPerTrigger": "1000000000",
    "maxRecordsPerPartition": "500000",
}


# Published batches that one batch of a reader takes of a topic with a log.
BATCHES_PER_TRIGGER = 10
# Options by which a stream lists its files; a batch that reads named ones has no use for them.
_LISTING = ("maxFileAge", "cleanSource", "sourceArchiveDir", "latestFirst")


def kafka_source_options(servers: str, topic: str, **options: object) -> dict[str, str]:
    """Options for ``format("kafka")``; those given win over the defaults, None drops one.

    Any of Kafka's may be given, such as ``failOnDataLoss`` or, in a dictionary,
    ``kafka.security.protocol``.  A batch read has no end to start from: give it
    ``startingOffsets="earliest"``.
    """
    chosen = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        **KAFKA_DEFAULTS,
        **options,
    }
    return {name: str(value) for name, value in chosen.items() if value is not None}


def read_topic(
    spark: SparkSession,
    fmt: str = "kafka",
    options: Mapping[str, object] | None = None,
    stream: bool = True,
) -> Stream:
    """The topic's envelope.

    Any format that yields the envelope will do; a file format needs its schema
    stated, a ``path``, and serves as the topic where there is no broker.  Where it
    has a log, only files that the log names are read.
    """
    options = dict(options or {})
    if fmt != "kafka":
        if has_log(spark, str(options["path"])):
            return _read_logged(spark, fmt, options, stream)
        # The folders in which batches stand are no columns of a message.
        options.setdefault("recursiveFileLookup", "true")
        return read_feed(spark, options.pop("path"), ddl(ENVELOPE_TYPES), stream, fmt, **options)
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).options(**options).load()


def _read_logged(
    spark: SparkSession, fmt: str, options: dict[str, object], stream: bool
) -> Stream:
    """What the log names, all of it or as it grows, some published batches at a time.

    ``maxFilesPerTrigger`` counts published batches; only the log is listed, not the data.
    """
    entries = log_of(str(options.pop("path")))
    bound = options.pop("maxFilesPerTrigger", BATCHES_PER_TRIGGER)
    options.pop("maxBytesPerTrigger", None)
    of_stream = {name: options.pop(name) for name in _LISTING if name in options}

    def read(names: DataFrame) -> DataFrame:
        here = names.sparkSession
        # One name for each file of the batches at hand, as Spark itself would list them.
        files = [row["file"] for row in names.select("file").distinct().collect()]
        if not files:
            return here.createDataFrame([], ddl(ENVELOPE_TYPES))
        return here.read.format(fmt).schema(ddl(ENVELOPE_TYPES)).options(**options).load(files)

    if not stream:
        return read(spark.read.schema(ddl(ENTRY_TYPES)).json(entries))
    bounds = {"maxFilesPerTrigger": bound, "maxBytesPerTrigger": None, **of_stream}
    return NamedStream(read_feed(spark, entries, ddl(ENTRY_TYPES), fmt="json", **bounds), read)
