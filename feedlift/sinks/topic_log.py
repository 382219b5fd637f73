"""The log of a topic kept as files: one entry for each batch, written last.

Data of a batch goes into a folder that no other attempt uses.  When all of it is there, an
entry that names its files is put into the log, once for each batch of a stream.  A batch
that runs again finds its entry and writes nothing, so files that a reader has seen are
never written anew; files of an attempt that was lost have no entry, and nobody reads them.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from feedlift.files import exists, files_in, folders_in, put_once, read_text, remove_folder
from feedlift.sinks.table import WriteBatch

log = logging.getLogger(__name__)

# One line of an entry; an entry without lines is a batch without rows.
ENTRY_TYPES = {"run": "STRING", "batch": "BIGINT", "rows": "BIGINT", "file": "STRING"}


def log_of(path: str) -> str:
    return f"{path.rstrip('/')}/topic-log"


def _data_of(path: str, run: str, number: int) -> str:
    return f"{path.rstrip('/')}/topic-data/{run}/{number}"


def _entry_of(path: str, run: str, number: int) -> str:
    return f"{log_of(path)}/{run}-{number:020d}.json"


def _rows_told(entry: str) -> int:
    return json.loads(entry.splitlines()[0])["rows"] if entry else 0


def has_log(spark: SparkSession, path: str) -> bool:
    return exists(spark, log_of(path))


def write_logged(path: str, fmt: str = "parquet", **options: object) -> WriteBatch:
    """A batch writer into a topic with a log.  It tells how many rows the batch has there."""

    def write(batch: DataFrame, run: str, number: int) -> int:
        spark, place = batch.sparkSession, _entry_of(path, run, number)
        entry = read_text(spark, place)
        if entry is not None:
            log.info("batch %d: in the log already, not written again", number)
            return _rows_told(entry)
        folder = f"{_data_of(path, run, number)}/{uuid.uuid4().hex}"
        counted = Observation()
        batch = batch.observe(counted, F.count(F.lit(1)).alias("rows"))
        batch.write.format(fmt).options(**options).save(folder)
        rows = counted.get["rows"]
        said = {"run": run, "batch": number, "rows": rows}
        names = [f"{folder}/{name}" for name, _ in files_in(spark, folder)]
        lines = [json.dumps(said | {"file": name}) + "\n" for name in names]
        if not put_once(spark, place, "".join(lines)):
            # Another driver that runs the same batch was faster: its files count.
            return _rows_told(read_text(spark, place) or "")
        return rows

    return write


def remove_unnamed(spark: SparkSession, path: str, run: str) -> int:
    """Deletes what lost attempts left of batches that are in the log; how many attempts."""
    removed = 0
    for number in folders_in(spark, f"{path.rstrip('/')}/topic-data/{run}"):
        entry = read_text(spark, _entry_of(path, run, int(number)))
        if entry is None:
            continue
        named = {json.loads(line)["file"].rsplit("/", 2)[-2] for line in entry.splitlines()}
        folder = _data_of(path, run, int(number))
        for attempt in folders_in(spark, folder):
            if attempt not in named:
                remove_folder(spark, f"{folder}/{attempt}")
                removed += 1
    return removed
