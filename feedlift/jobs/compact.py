"""Closed batches of an exact table into few large files; may be stopped and started anywhere.

    spark-submit feedlift/jobs/compact.py --table lake.posts --folder s3a://bucket/archive
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession

from feedlift.sinks.compact import compact, runs_of

log = logging.getLogger(__name__)


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Archive closed batches of a table.")
    parser.add_argument("--table", required=True, help="a table that replaces its batches")
    parser.add_argument("--folder", required=True, help="where the archive's files go")
    parser.add_argument("--run", help="one stream's id; by default all that have written there")
    parser.add_argument(
        "--leave", type=int, default=1,
        help="newest batches of each stream to leave: one may be written again as long as it runs",
    )
    arguments = parser.parse_args(argv)
    if arguments.leave < 1:
        parser.error("--leave: the newest batch of a stream may be written again")
    return arguments


def start(spark: SparkSession, arguments: argparse.Namespace) -> None:
    for run, newest in runs_of(spark, arguments.table).items():
        if arguments.run in (None, run):
            compact(spark, arguments.table, run, newest - arguments.leave, arguments.folder)
            log.info("%s: archived batches up to %d", run, newest - arguments.leave)


def main(argv: Sequence[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    arguments = parse(argv)
    start(SparkSession.builder.appName("feedlift compact").getOrCreate(), arguments)


if __name__ == "__main__":
    main()
