"""A feed of posts, staged as files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


# What one batch takes of a backlog unless told otherwise, in bytes of files.
BACKLOG_BYTES = 512 * 1024**3
# Spark passes over files dated this long before the newest it has seen.  Its own
# week would lose files that are copied with their old dates; a hundred years reach
# behind 1970, the oldest date a file has.
FILE_AGE = "36525d"


def read_feed(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    stream: bool = True,
    fmt: str = "parquet",
    **options: object,
) -> DataFrame:
    """Posts under ``path``, as an endless stream or as what is there now.

    A stream's batches are bounded, so that one lost with the driver is soon
    done again; the rest of a backlog waits for later batches.  Set the bound
    with ``maxBytesPerTrigger`` (None for no bound) or ``maxFilesPerTrigger``.
    Every file is taken once, however old its date; where so many arrive that
    listing them for each batch takes long, have finished ones moved away with
    ``cleanSource`` and ``sourceArchiveDir``.
    """
    if not stream:
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    if "maxFilesPerTrigger" not in options:
        options.setdefault("maxBytesPerTrigger", BACKLOG_BYTES)
    options.setdefault("maxFileAge", FILE_AGE)
    options = {name: value for name, value in options.items() if value is not None}
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def one_table(folder: str, name: str) -> str:
    """A path to ``name`` that a stream accepts, be it one file or a folder of files.

    A streaming read refuses the path of a single file but takes a pattern.
    """
    return f"{folder}/{{{name}}}"
