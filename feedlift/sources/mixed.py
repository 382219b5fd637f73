"""A feed whose files state their counts as different types.

Readers of files that carry their types take one type for a column.  So a stream lists the
files without opening them, and each batch reads the types of its own files, groups
the files by them, scans every group as what it is and unites the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedlift.functions.values import to_whole
from feedlift.schema import RAW_TYPES, ddl
from feedlift.sources.feed import read_feed
from feedlift.sources.named import NamedStream, Stream

# Formats whose files carry the types of their columns.
TYPED = ("parquet", "orc")
# Files of one batch, unless told otherwise: their footers are read before their rows.
MOST_FILES = 10_000
# What Spark lists of a file whose content nobody asks for.
_LISTED = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
_CLASH = "CANNOT_MERGE_SCHEMAS"


def _merged(spark: SparkSession, files: Sequence[str], fmt: str) -> StructType | None:
    """The one schema of some files, from footers that executors read; None if they clash."""
    try:
        return spark.read.format(fmt).option("mergeSchema", "true").load(list(files)).schema
    except (Py4JJavaError, PySparkException) as clash:
        if _CLASH not in str(clash):
            raise
        return None


def by_types(
    spark: SparkSession, files: Sequence[str], fmt: str, columns: Sequence[str]
) -> dict[tuple[str | None, ...], list[str]]:
    """Files by the types that ``columns`` have in them; None for a column that is not there.

    Files of one schema take one job, and types that change k times from file to file
    some k log(n) of them: files that clash are halved until they do not.
    """
    groups: dict[tuple[str | None, ...], list[str]] = {}
    waiting = [list(files)] if files else []
    while waiting:
        some = waiting.pop()
        schema = _merged(spark, some, fmt)
        if schema is None:
            middle = len(some) // 2
            waiting += [some[middle:], some[:middle]]
            continue
        types = {field.name: field.dataType.simpleString() for field in schema}
        groups.setdefault(tuple(types.get(name) for name in columns), []).extend(some)
    return groups


def _read_group(
    spark: SparkSession,
    files: Sequence[str],
    fmt: str,
    types: dict[str, str],
    counts: dict[str, str | None],
    options: dict[str, object],
) -> DataFrame:
    """Files whose ``counts`` have those types, with counts as BIGINT."""
    stated = {name: counts.get(name) or "BIGINT" for name in types if name in counts}
    rows = spark.read.format(fmt).schema(ddl(types | stated)).options(**options).load(list(files))
    whole = [name for name, kind in stated.items() if kind != "bigint"]
    return rows.withColumns({name: to_whole(F.col(name)) for name in whole})


def read_mixed(
    spark: SparkSession,
    files: Sequence[str],
    counts: Sequence[str],
    fmt: str = "parquet",
    more: dict[str, str] | None = None,
    **options: object,
) -> DataFrame:
    """Raw posts of some files, and the columns of ``more``; one scan for each set of types.

    ``counts`` come as BIGINT, truncated toward zero as their normalisation would; what has
    no such value, and a count that a file does not have, is NULL.  No files are no rows.
    """
    types = RAW_TYPES | (more or {}) | dict.fromkeys(counts, "BIGINT")
    rows = None
    for stated, some in by_types(spark, files, fmt, counts).items():
        named = dict(zip(counts, stated, strict=True))
        part = _read_group(spark, some, fmt, types, named, options)
        rows = part if rows is None else rows.unionByName(part)
    return spark.createDataFrame([], ddl(types)) if rows is None else rows


def mixed_feed(
    spark: SparkSession,
    path: str,
    counts: Sequence[str],
    fmt: str = "parquet",
    more: dict[str, str] | None = None,
    **options: object,
) -> Stream:
    """Posts under ``path`` as a stream, whatever types their files state for ``counts``.

    Nothing is inferred at the start, when the feed may still be empty.  Where files carry no
    types, as JSON does, counts are read as the text they are and every digit stays.
    Bounds and archives are those of :func:`read_feed`; a batch has ``MOST_FILES`` at most.
    """
    if fmt not in TYPED:
        types = RAW_TYPES | (more or {}) | dict.fromkeys(counts, "STRING")
        feed = read_feed(spark, path, ddl(types), fmt=fmt, **options)
        return feed.withColumns({name: _whole_text(name) for name in counts})
    of_stream = {name: options.pop(name) for name in _OF_STREAM if name in options}
    if "maxBytesPerTrigger" not in of_stream:
        of_stream.setdefault("maxFilesPerTrigger", MOST_FILES)
    names = read_feed(spark, path, _LISTED, fmt="binaryFile", **of_stream).select("path")

    def read(batch: DataFrame) -> DataFrame:
        # One name for each file of the batch, in order, so that runs of one type stay together.
        files = [row["path"] for row in batch.orderBy("path").collect()]
        return read_mixed(batch.sparkSession, files, counts, fmt, more, **options)

    return NamedStream(names, read)


_OF_STREAM = (
    "maxFilesPerTrigger", "maxBytesPerTrigger", "maxFileAge", "cleanSource", "sourceArchiveDir",
    "pathGlobFilter", "recursiveFileLookup", "latestFirst",
)


def _whole_text(name: str) -> Column:
    """A count's text as BIGINT: as it stands, or truncated where it has a fraction."""
    text = F.col(name)
    kinds = ("decimal(38,18)", "double")
    return F.coalesce(to_whole(text), *(to_whole(text.try_cast(kind)) for kind in kinds))
