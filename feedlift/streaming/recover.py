"""Going on from what the target holds, where a checkpoint is lost."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.files import exists
from feedlift.operators.offsets import PARTITION, RANGE_TYPES, outside, ranges
from feedlift.schema import ddl
from feedlift.sources.named import Stream

# Fixed value: what Kafka's source takes for the begin of a partition.
EARLIEST = -2


def starting_offsets(found: DataFrame, topic: str, partitions: Iterable[int] = ()) -> str:
    """Kafka's ``startingOffsets``: behind the first range that the target has of each partition.

    What is there behind a gap is read again; :func:`not_yet_taken` leaves it out.  Kafka wants all
    partitions named: ``partitions`` that the target has nothing of are read from their begin.
    A row for each partition comes to the driver.
    """
    first = F.min_by("last", "first").alias("last")
    heads = found.groupBy(PARTITION).agg(first).collect()
    offsets = dict.fromkeys(partitions, EARLIEST) | {row[0]: row[1] + 1 for row in heads}
    named = {str(partition): offset for partition, offset in sorted(offsets.items())}
    return json.dumps({topic: named})


def held_ranges(spark: SparkSession, target: DataFrame, checkpoint: str) -> DataFrame:
    """Ranges of offsets the target held when a stream with this checkpoint first started.

    They are found once and kept with the checkpoint: what the stream itself writes
    later must not count as taken, since messages need not come in order.
    """
    kept = f"{checkpoint}/recovered"
    if not exists(spark, f"{kept}/_SUCCESS"):
        ranges(target).coalesce(1).write.mode("overwrite").parquet(kept)
    return spark.read.schema(ddl(RANGE_TYPES)).parquet(kept)


def not_yet_taken(envelope: Stream, found: DataFrame) -> Stream:
    """The messages of a topic that lie in none of the ranges."""
    return envelope.transform(outside, found, "partition", "offset")


def resume_behind(envelope: Stream, target: DataFrame, checkpoint: str) -> Stream:
    """The topic without what ``target`` has of it, for a stream whose checkpoint is new.

    Start the stream at the topic's begin, or for Kafka at :func:`starting_offsets`.  Give the
    same every time: a restart with its checkpoint leaves out what the first start did.
    """
    return not_yet_taken(envelope, held_ranges(envelope.sparkSession, target, checkpoint))
