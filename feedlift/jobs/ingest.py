"""A topic's posts to a table, until stopped.

    spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2 \\
        feedlift/jobs/ingest.py --topic-option kafka.bootstrap.servers=host:9092 \\
        --topic-option subscribe=posts --table lake.posts --checkpoint s3a://…/ingest
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from feedlift.files import exists
from feedlift.jobs.arguments import (
    add_options,
    add_running,
    checkpoint,
    clean_source,
    topic_options,
    trigger,
)
from feedlift.operators.messages import read_posts
from feedlift.operators.placement import Measured, Spread, by_key, rebalance
from feedlift.schema import ddl, target_read_types
from feedlift.sinks.merge import merge_into
from feedlift.sinks.table import WriteBatch, append_to, replace_in_folder
from feedlift.sources.named import NamedStream
from feedlift.sources.topic import kafka_source_options, read_topic
from feedlift.streaming.audit import audited, read_folder_batch, read_table_batch
from feedlift.streaming.dedup import KEPT_FOR, take_once
from feedlift.streaming.ingest import start_folder_ingest, start_ingest, start_table_ingest
from feedlift.streaming.lag import with_lags
from feedlift.streaming.recover import held_ranges, not_yet_taken, starting_offsets
from feedlift.streaming.run import has_progress, skip_existing

SPREADS = ("none", "rebalance", "key", "fixed", "measured")
PARTITIONS = 6
# Table formats whose partitions are folders of files, as many as there are batches.
PLAIN_FILES = ("parquet", "orc", "csv", "json", "avro", "text")
ONE_PASS = ""


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Ingest posts from a topic.")
    parser.add_argument("--topic-format", default="kafka")
    add_options(parser, "--topic-option", "option of the topic's format")
    target = parser.add_mutually_exclusive_group(required=True)
    target.add_argument("--table", help="catalog table, created if need be")
    target.add_argument("--folder", help="folder of parquet files")
    target.add_argument("--sink-format", help="any other data source, at least once")
    add_options(parser, "--sink-option", "option of the sink's format")
    parser.add_argument(
        "--look-first", action="store_true", help="sink: must be readable before the stream starts"
    )
    parser.add_argument("--provider", default="parquet", help="of a new table; '' for none")
    parser.add_argument("--location", help="of a new table")
    parser.add_argument("--at-least-once", action="store_true", help="append to the table")
    parser.add_argument(
        "--outcomes", action="store_true", help="folder: rows and rejects apart, in one pass"
    )
    parser.add_argument("--skip-existing", action="store_true", help="files: start behind them")
    parser.add_argument("--skip-empty", action="store_true")
    parser.add_argument(
        "--drop-repeats", metavar="INTERVAL", nargs="?", const=KEPT_FOR,
        help="take a message once that comes again within this time; not for topics with a log",
    )
    parser.add_argument(
        "--lengths",
        choices=["unbounded", "enforce"],
        default="unbounded",
        help="of a new table's texts; to enforce them, longer ones need --rejects",
    )
    parser.add_argument(
        "--spread",
        choices=SPREADS,
        help="where rows go before a write; fixed: by community, into --partitions; measured: "
        "into --partitions, communities in as many as their size in the batch before; "
        "by default none, or rebalance where a batch is a partition of a table",
    )
    parser.add_argument("--partitions", type=int, default=PARTITIONS)
    parser.add_argument("--audit", metavar="FOLDER", help="keep the ranges of offsets that came")
    parser.add_argument("--lags", metavar="FOLDER", help="keep sketches of lag and size")
    parser.add_argument(
        "--merge", metavar="FOLDER", help="sink: each row once, by staging batches in this folder"
    )
    parser.add_argument(
        "--recover", action="store_true",
        help="no checkpoint: go on behind what the target has of the topic",
    )
    parser.add_argument(
        "--topic-partitions", type=int, default=0, help="kafka with --recover: how many there are"
    )
    add_running(parser, rejects_here=True)
    arguments = parser.parse_args(argv)
    if arguments.outcomes and (arguments.rejects or not arguments.folder):
        parser.error("--outcomes goes with --folder, without a folder of --rejects")
    if arguments.rejects == ONE_PASS:
        if not arguments.folder:
            parser.error("--rejects needs a folder, but with --folder")
        arguments.outcomes, arguments.rejects = True, None
    if arguments.merge and not arguments.sink_format:
        parser.error("--merge goes with --sink-format; tables and folders replace their batches")
    if arguments.recover and arguments.skip_existing:
        parser.error("--recover goes on behind the target, --skip-existing behind the topic")
    if arguments.lengths == "enforce" and not arguments.rejects:
        parser.error("--lengths enforce needs --rejects: a long text would stop the job for good")
    exact = arguments.table and not arguments.at_least_once
    unpaced = not (arguments.every or arguments.all_now)
    if exact and unpaced and arguments.provider in PLAIN_FILES:
        parser.error(
            "every batch becomes a partition of the table: give --every or --all-now, "
            "or --at-least-once"
        )
    if arguments.spread is None:
        arguments.spread = "rebalance" if exact and arguments.provider in PLAIN_FILES else "none"
    arguments.topic = topic_options(parser, arguments, "kafka.bootstrap.servers", "subscribe")
    return arguments


def spread(arguments: argparse.Namespace) -> Spread | None:
    """Rows of a community together and in a fixed number of partitions, or as told."""
    return {
        "none": None,
        "rebalance": rebalance(),
        "key": rebalance("subreddit"),
        "fixed": by_key("subreddit", arguments.partitions, salts=1),
        "measured": Measured("subreddit", arguments.partitions),
    }[arguments.spread]


def held_rows(spark: SparkSession, arguments: argparse.Namespace) -> DataFrame:
    """Target rows that are there before the stream starts; none where there is no target."""
    schema = ddl(target_read_types())
    if arguments.table:
        if spark.catalog.tableExists(arguments.table):
            return spark.table(arguments.table)
    elif arguments.sink_format:
        options = dict(arguments.sink_option)
        return spark.read.format(arguments.sink_format).options(**options).load()
    elif exists(spark, arguments.folder):
        reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(arguments.folder)
    return spark.createDataFrame([], schema)


def behind_target(
    spark: SparkSession, arguments: argparse.Namespace, options: dict[str, str], place: str
) -> tuple[dict[str, str], DataFrame]:
    """The topic's options, and the ranges of offsets that a lost checkpoint stood for."""
    found = held_ranges(spark, held_rows(spark, arguments), place)
    if arguments.topic_format == "kafka" and not has_progress(spark, place):
        partitions = range(arguments.topic_partitions)
        offsets = starting_offsets(found, options["subscribe"], partitions)
        options = options | {"startingOffsets": offsets}
    return options, found


def beside(arguments: argparse.Namespace) -> Callable[[WriteBatch], WriteBatch]:
    """What is kept of each batch beside the target, off what the target then has of it."""
    exact = arguments.table and not arguments.at_least_once
    back = read_table_batch(arguments.table) if exact else None
    if arguments.folder and not arguments.outcomes:
        back = read_folder_batch(arguments.folder)

    def around(write: WriteBatch) -> WriteBatch:
        if arguments.audit:
            write = audited(write, arguments.audit, back)
        return with_lags(write, arguments.lags, back) if arguments.lags else write

    return around


def start(spark: SparkSession, arguments: argparse.Namespace) -> StreamingQuery:
    target = arguments.table or arguments.folder or arguments.sink_format
    fmt, options = arguments.topic_format, dict(arguments.topic)
    kind = "table" if arguments.table else "folder" if arguments.folder else "sink"
    place = checkpoint(
        spark, arguments, "ingest", fmt, options, kind, target, dict(arguments.sink_option)
    )
    if fmt == "kafka":
        servers, topic = options.pop("kafka.bootstrap.servers"), options.pop("subscribe")
        options = kafka_source_options(servers, topic, **options)
    else:
        if arguments.skip_existing:
            no_bound = {"maxBytesPerTrigger": None, "maxFilesPerTrigger": None}
            whole = read_topic(spark, fmt, options | no_bound)
            skip_existing(whole.transform(read_posts), place)
        options |= clean_source(arguments)
    found = None
    if arguments.recover:
        options, found = behind_target(spark, arguments, options, place)
    envelope = read_topic(spark, fmt, options)
    if found is not None:
        envelope = not_yet_taken(envelope, found)
    if arguments.drop_repeats:
        if isinstance(envelope, NamedStream):
            raise SystemExit("--drop-repeats: a topic with a log has no repeats to drop")
        envelope = take_once(envelope, arguments.drop_repeats)
    how = {
        "spread": spread(arguments),
        "trigger": trigger(arguments),
        "name": f"ingest {target}",
    }
    how["skip_empty"] = arguments.skip_empty
    around = beside(arguments)
    if arguments.outcomes:
        return start_folder_ingest(envelope, arguments.folder, place, around=around, **how)
    how["write_rejects"] = replace_in_folder(arguments.rejects) if arguments.rejects else None
    if arguments.table:
        return start_table_ingest(
            spark,
            envelope,
            arguments.table,
            place,
            exact=not arguments.at_least_once,
            provider=arguments.provider or None,
            location=arguments.location,
            bounded=arguments.lengths == "enforce",
            around=around,
            **how,
        )
    if arguments.folder:
        return start_ingest(envelope, place, around(replace_in_folder(arguments.folder)), **how)
    options = dict(arguments.sink_option)
    write = append_to(arguments.sink_format, **options)
    if arguments.merge:
        write = merge_into(write, lambda here: held_rows(here, arguments), arguments.merge)

    def prepare() -> None:
        # A first look at the target: one that cannot be reached stops the job here.
        if arguments.look_first:
            spark.read.format(arguments.sink_format).options(**options).load().schema  # noqa: B018

    return start_ingest(envelope, place, around(write), prepare=prepare, **how)


def main(argv: Sequence[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    arguments = parse(argv)
    spark = SparkSession.builder.appName("feedlift ingest").getOrCreate()
    start(spark, arguments).awaitTermination()


if __name__ == "__main__":
    main()
