"""Each row once in a sink that can only append.

A batch is staged, so that it is the same rows however often it runs, and a ledger beside
it tells how far it has come: ``staged``, ``appending``, ``done``.  A batch that runs again
after it was done appends nothing.  One that was lost while appending looks
into the sink for the places its rows came from, and appends those that are not there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from feedlift.files import put_once, read_text, remove_folder
from feedlift.operators.offsets import OFFSET, PARTITION
from feedlift.sinks.table import WriteBatch

_NOT_THERE = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _missing(
    staged: DataFrame, read_sink: Callable[[SparkSession], DataFrame], key: Sequence[str]
) -> DataFrame:
    """Rows of ``staged`` whose key is not in the sink; only the keys in their range are read."""
    lowest, highest = staged.agg(F.min(key[-1]), F.max(key[-1])).first()
    if lowest is None:
        return staged
    try:
        held = read_sink(staged.sparkSession)
    except AnalysisException as missing:
        if missing.getCondition() not in _NOT_THERE:
            raise
        return staged
    held = held.where(F.col(key[-1]).between(lowest, highest)).select(*key)
    return staged.join(held, list(key), "left_anti")


def merge_into(
    append: WriteBatch,
    read_sink: Callable[[SparkSession], DataFrame],
    staging: str,
    key: Sequence[str] = (PARTITION, OFFSET),
) -> WriteBatch:
    """A batch writer that appends by ``append`` and leaves each row there once.

    ``read_sink`` reads the sink; it is called only for a batch that was lost while
    appending, and what it reads is bounded by the batch's offsets, a filter that files and
    databases take over.  The sink must show a row either whole or not at all, and take
    from one stream at a time the places of ``key``.  ``staging`` must be shared; of
    each stream the last two batches' entries are kept there, and no staged rows but
    those of the batch at hand.
    """

    def write(batch: DataFrame, run: str, number: int) -> int:
        spark, ledger = batch.sparkSession, f"{staging.rstrip('/')}/ledger/{run}"
        entry = f"{ledger}/{number:020d}"
        done = read_text(spark, f"{entry}/done")
        if done is not None:
            return int(done)
        told = read_text(spark, f"{entry}/staged")
        if told is None:
            folder = f"{staging.rstrip('/')}/staged/{run}-{number}-{uuid.uuid4().hex}"
            counted = Observation()
            rows = batch.observe(counted, F.count(F.lit(1)).alias("rows"))
            rows.write.parquet(folder)
            told = json.dumps({"folder": folder, "rows": counted.get["rows"]})
            if not put_once(spark, f"{entry}/staged", told):
                told = read_text(spark, f"{entry}/staged")
        stage = json.loads(told)
        staged = spark.read.schema(batch.schema).parquet(stage["folder"])
        first = put_once(spark, f"{entry}/appending", "")
        append(staged if first else _missing(staged, read_sink, key), run, number)
        put_once(spark, f"{entry}/done", str(stage["rows"]))
        remove_folder(spark, stage["folder"])
        remove_folder(spark, f"{ledger}/{number - 2:020d}")
        return stage["rows"]

    return write
