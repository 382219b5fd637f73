"""What happens to one micro-batch."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from feedlift.files import exists, remove_folder
from feedlift.operators.placement import Spread
from feedlift.session import shared_root
from feedlift.sinks.table import WriteBatch

log = logging.getLogger(__name__)

OnCount = Callable[[int, int], None]
# Column by which a staged batch is split.
_REJECTED = "rejected"


def _log_count(number: int, rows: int) -> None:
    log.info("batch %d: %d rows", number, rows)


def _log_rejects(number: int, rows: int) -> None:
    log.info("batch %d: %d rows set aside", number, rows)


def _run_id(batch: DataFrame) -> str:
    """The stream's id: made with its checkpoint, the same after every restart."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write_counted(
    write: WriteBatch, rows: DataFrame, run: str, number: int, spread: Spread | None
) -> int:
    """Write, and count with the same action what was written, and what the spread measures."""
    counted = Observation()
    measures = spread.measures() if hasattr(spread, "measures") else []
    rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"), *measures)
    told = write(spread(rows) if spread else rows, run, number)
    if told is not None:
        return told
    if measures:
        spread.learn(counted.get)
    return counted.get["rows"]


def batch_writer(
    write: WriteBatch,
    spread: Spread | None = None,
    on_count: OnCount = _log_count,
    skip_empty: bool = False,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: one action and one pass over the source per batch.

    The row count is taken by the write itself, not by a count before it, and
    nothing is cached.  An empty batch adds no rows; ``skip_empty`` looks for a
    first row beforehand, for sinks where even an empty write is dear.  The
    count is for the log: a task that ran twice may be in it twice.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        if skip_empty and batch.isEmpty():
            log.info("batch %d: empty, not written", number)
            return
        on_count(number, _write_counted(write, batch, _run_id(batch), number, spread))

    return write_batch


def splitting_writer(
    write: WriteBatch,
    write_rejects: WriteBatch,
    accept: Callable[[DataFrame], DataFrame],
    spread: Spread | None = None,
    on_count: OnCount = _log_count,
    on_rejects: OnCount = _log_rejects,
    staging: str | None = None,
    skip_empty: bool = False,
) -> Callable[[DataFrame, int], None]:
    """Rows without ``reject_reason`` go through ``accept`` to ``write``, others aside.

    The source is read once: one write stages the batch, split by outcome, below ``staging``
    on shared storage, and each side is published from there.  Nothing is kept by executors, so
    nothing is computed again when one is lost, and both sides are of the same reading.
    What is staged goes when the batch is done, or is replaced when it runs again.

    Rejects go first: give a ``write_rejects`` that replaces its batch, and only the
    failure of ``write`` itself can repeat rows of an append.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        run, spark = _run_id(batch), batch.sparkSession
        if skip_empty and batch.isEmpty():
            log.info("batch %d: empty, not written", number)
            return
        folder = f"{staging or shared_root(spark) + '/staged'}/{run}-{number}"

        def side(rejected: bool) -> DataFrame:
            path = f"{folder}/{_REJECTED}={str(rejected).lower()}"
            if not exists(spark, path):
                return spark.createDataFrame([], batch.schema)
            return spark.read.schema(batch.schema).parquet(path)

        try:
            split = batch.withColumn(_REJECTED, F.col("reject_reason").isNotNull())
            split.write.mode("overwrite").partitionBy(_REJECTED).parquet(folder)
            on_rejects(number, _write_counted(write_rejects, side(True), run, number, None))
            on_count(number, _write_counted(write, accept(side(False)), run, number, spread))
        finally:
            remove_folder(spark, folder)

    return write_batch
