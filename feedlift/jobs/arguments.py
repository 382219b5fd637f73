"""Arguments the two jobs share."""

from __future__ import annotations

import argparse
import hashlib
import json

from pyspark.sql import SparkSession

from feedlift.streaming.run import ALL_NOW, Trigger


def pair(text: str) -> tuple[str, str]:
    name, equals, value = text.partition("=")
    if not (name and equals):
        raise argparse.ArgumentTypeError(f"expected name=value, not {text!r}")
    return name, value


def add_options(parser: argparse.ArgumentParser, flag: str, what: str) -> None:
    parser.add_argument(
        flag, type=pair, action="append", default=[], metavar="NAME=VALUE", help=what
    )


def topic_options(
    parser: argparse.ArgumentParser, arguments: argparse.Namespace, *kafka_needs: str
) -> dict[str, str]:
    """The topic's options, or an error that names those it lacks."""
    options = dict(arguments.topic_option)
    needs = kafka_needs if arguments.topic_format == "kafka" else ("path",)
    missing = [name for name in needs if name not in options]
    if missing:
        parser.error(f"missing --topic-option: {', '.join(missing)}")
    return options


def add_running(parser: argparse.ArgumentParser, rejects_here: bool = False) -> None:
    """``rejects_here`` lets rejects go below the target itself, where no folder is named."""
    parser.add_argument("--checkpoint", help="folder of the stream's progress")
    named = {"nargs": "?", "const": ""} if rejects_here else {}
    parser.add_argument("--rejects", help="folder for rows set aside, in parquet", **named)
    parser.add_argument(
        "--archive", help="files: folder for finished ones, so that listing the others stays short"
    )
    when = parser.add_mutually_exclusive_group()
    when.add_argument("--every", metavar="INTERVAL", help="start batches at this interval")
    when.add_argument("--all-now", action="store_true", help="stop after what is there now")


def clean_source(arguments: argparse.Namespace) -> dict[str, str]:
    """Options by which a source of files moves away what it has finished with."""
    if not arguments.archive:
        return {}
    return {"cleanSource": "archive", "sourceArchiveDir": arguments.archive}


def checkpoint(spark: SparkSession, arguments: argparse.Namespace, job: str, *ends: object) -> str:
    """Where the progress is kept: as told, or by a hash of all that says from where to where.

    Never in a folder of this process: the next start would not find it.
    """
    if arguments.checkpoint:
        return arguments.checkpoint
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise SystemExit("give --checkpoint, or set spark.checkpoint.dir to a shared folder")
    named = hashlib.sha256(json.dumps([job, *ends], sort_keys=True).encode()).hexdigest()
    return f"{root.rstrip('/')}/{job}-{named[:32]}"


def trigger(arguments: argparse.Namespace) -> Trigger | None:
    if arguments.all_now:
        return ALL_NOW
    return {"processingTime": arguments.every} if arguments.every else None
