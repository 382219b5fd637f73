"""A staged feed's posts to a topic, until stopped.

    spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2 \\
        feedlift/jobs/publish.py --feed s3a://…/posts --checkpoint s3a://…/publish \\
        --topic-option kafka.bootstrap.servers=host:9092 --topic-option topic=posts
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from feedlift.jobs.arguments import (
    add_options,
    add_running,
    checkpoint,
    clean_source,
    topic_options,
    trigger,
)
from feedlift.operators.normalize import REQUIRED_WHOLE
from feedlift.schema import ENVELOPE_TYPES, RAW_TYPES, ddl
from feedlift.sinks.table import append_to, replace_in_folder
from feedlift.sinks.topic import PLACE, place_as_files, stream_topic, to_file_topic
from feedlift.sources.feed import read_feed
from feedlift.sources.mixed import mixed_feed
from feedlift.sources.named import Stream
from feedlift.streaming.ingest import posts_to_messages, start_publish
from feedlift.streaming.run import skip_existing


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Publish a feed of posts to a topic.")
    parser.add_argument("--feed", required=True, help="folder the posts arrive in")
    parser.add_argument("--feed-format", default="parquet")
    add_options(parser, "--feed-option", "option of the feed's format")
    parser.add_argument("--topic-format", default="kafka")
    add_options(parser, "--topic-option", "option of the topic's format")
    parser.add_argument(
        "--counts", help="one type for the feed's counts; by default each file's own"
    )
    parser.add_argument("--include-existing", action="store_true", help="also what is there now")
    add_running(parser)
    arguments = parser.parse_args(argv)
    arguments.topic = topic_options(parser, arguments, "kafka.bootstrap.servers", "topic")
    return arguments


def _to_files(raw: DataFrame) -> DataFrame:
    return place_as_files(posts_to_messages(raw, PLACE), "posts")


def start(spark: SparkSession, arguments: argparse.Namespace) -> StreamingQuery:
    fmt = arguments.topic_format
    to_broker = fmt == "kafka"
    to_messages = posts_to_messages if to_broker else _to_files
    places = {name: ENVELOPE_TYPES[name] for name in PLACE if not to_broker}
    place = checkpoint(
        spark, arguments, "publish", arguments.feed_format, arguments.feed, fmt, arguments.topic
    )

    def feed(**options: object) -> Stream:
        options = {**dict(arguments.feed_option), **options, "fmt": arguments.feed_format}
        if not arguments.counts:
            return mixed_feed(spark, arguments.feed, REQUIRED_WHOLE, more=places, **options)
        types = RAW_TYPES | dict.fromkeys(REQUIRED_WHOLE, arguments.counts) | places
        return read_feed(spark, arguments.feed, ddl(types), **options)

    if not arguments.include_existing:
        skip_existing(feed(maxBytesPerTrigger=None, maxFilesPerTrigger=None), place)
    raw, when = feed(**clean_source(arguments)), trigger(arguments)
    if not arguments.rejects:
        return stream_topic(raw.transform(to_messages), place, fmt, arguments.topic, when)
    if to_broker:
        write = append_to(fmt, **arguments.topic)
    else:
        write = to_file_topic(raw, fmt, arguments.topic)
    aside = replace_in_folder(arguments.rejects)
    return start_publish(raw, place, write, aside, to_messages, when, "publish")


def main(argv: Sequence[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    arguments = parse(argv)
    spark = SparkSession.builder.appName("feedlift publish").getOrCreate()
    start(spark, arguments).awaitTermination()


if __name__ == "__main__":
    main()
