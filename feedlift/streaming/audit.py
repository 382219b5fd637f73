"""Offsets that never came, known batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.operators.offsets import RANGE_TYPES, gaps, merged, ranges
from feedlift.schema import ddl
from feedlift.sinks.table import BATCH, RUN, WriteBatch, replace_in_folder

ReadBack = Callable[[SparkSession, str, int], DataFrame]


def audited(write: WriteBatch, audit: str, read_back: ReadBack | None = None) -> WriteBatch:
    """``write``, and beside it the ranges of offsets that the batch has, below ``audit``.

    A batch that runs again replaces its ranges.  They are read off what ``read_back`` finds of
    the batch in the target, two columns of it; without it off the batch, which
    reads the places of the source's messages again.
    """

    def write_batch(batch: DataFrame, run: str, number: int) -> int | None:
        told = write(batch, run, number)
        rows = read_back(batch.sparkSession, run, number) if read_back else batch
        replace_in_folder(audit)(ranges(rows).coalesce(1), run, number)
        return told

    return write_batch


def read_folder_batch(path: str, fmt: str = "parquet") -> ReadBack:
    """What :func:`replace_in_folder` wrote of a batch."""
    return lambda spark, run, number: spark.read.format(fmt).load(
        f"{path}/{RUN}={run}/{BATCH}={number}"
    )


def read_table_batch(name: str) -> ReadBack:
    """What :func:`replace_in_table` wrote of a batch."""

    def read(spark: SparkSession, run: str, number: int) -> DataFrame:
        spark.catalog.refreshTable(name)
        return spark.table(name).where((F.col(RUN) == run) & (F.col(BATCH) == number))

    return read


def audited_ranges(spark: SparkSession, audit: str) -> DataFrame:
    """What has come so far, over all batches: a row for each range."""
    return merged(spark.read.schema(ddl(RANGE_TYPES)).parquet(audit))


def audited_gaps(spark: SparkSession, audit: str) -> DataFrame:
    """What is missing between offsets that have come; an offset that comes late closes its gap."""
    return gaps(audited_ranges(spark, audit))
