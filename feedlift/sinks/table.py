"""Target rows to a typed table.

A batch may be handed over twice: a job that fails after the write and before
the commit runs that batch again.  The ``append_*`` writers then append twice;
the ``replace_*`` writers put each batch in a place of its own and overwrite it,
so that what a reader sees is exact.

Spark's writers of plain files share a work folder per table: let one stream
write such a table.  Batches that are folders of their own do not share it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feedlift.schema import TARGET_COLUMNS, TARGET_TYPES, ddl, target_read_types

# Columns that tell whose batch a row came with, in tables that replace batches.
RUN, BATCH = "ingest_run", "ingest_batch"

# Takes a batch, the id of the stream that made it and the batch's number, and
# runs an action on that batch, the one its rows are counted by; or it tells their number
# itself, where it may find that there is nothing to do.
WriteBatch = Callable[[DataFrame, str, int], int | None]


def ensure_table(
    spark: SparkSession,
    name: str,
    provider: str | None = "parquet",
    location: str | None = None,
    replaces_batches: bool = False,
    bounded: bool = True,
) -> None:
    """Create the target table unless it is there.

    ``name`` may be in any catalog the session knows; give no ``provider`` for
    one that picks its own.  ``replaces_batches`` partitions the table for
    :func:`replace_in_table`.  Without ``bounded`` its texts may be of any length.
    """
    types = dict(TARGET_TYPES if bounded else target_read_types())
    if replaces_batches:
        types |= {RUN: "STRING", BATCH: "BIGINT"}
    statement = f"CREATE TABLE IF NOT EXISTS {name} ({ddl(types)})"
    if provider:
        statement += f" USING {provider}"
    if replaces_batches:
        statement += f" PARTITIONED BY ({RUN}, {BATCH})"
    if location:
        statement += f" LOCATION '{location}'"
    spark.sql(statement)


def bounded_columns(spark: SparkSession, name: str) -> list[str]:
    """Columns of a table that refuse texts beyond a length."""
    rows = spark.sql(f"DESCRIBE TABLE {name}").collect()  # a row for each column
    bounded = ("varchar", "char")
    return [row["col_name"] for row in rows if (row["data_type"] or "").startswith(bounded)]


# Types that hold every value of a target column's type; texts are looked at by their length.
_HOLD = {
    "int": {"int", "bigint"},
    "bigint": {"bigint"},
    "double": {"double"},
    "timestamp_ntz": {"timestamp_ntz"},
    "string": {"string"},
}


@dataclass
class Differences:
    """What a table that was found lacks of the target: columns, types, partitions."""

    missing: list[str]
    narrower: dict[str, str]
    partitions: list[str]

    def said(self) -> str:
        out = [f"has no column {name}" for name in self.missing]
        out += [f"has {name} as {kind}" for name, kind in self.narrower.items()]
        out += [f"is not partitioned by {name}" for name in self.partitions]
        return "; ".join(out)


def _holds(kind: str, wanted: str) -> bool:
    """Whether a column of ``kind`` takes all that is ``wanted``; any length of text is a text."""
    if kind.startswith(("varchar", "char")):
        kind = "string"
    return kind in _HOLD.get(wanted, {wanted})


def differences(spark: SparkSession, name: str, replaces_batches: bool = False) -> Differences:
    """What keeps target rows from being written into table ``name``.

    Columns go by name, whatever their order and capitals; columns that the target does not
    have are no difference, they are NULL in what is written.
    """
    rows = spark.sql(f"DESCRIBE TABLE {name}").collect()  # a row for each column
    names = [row["col_name"] for row in rows]
    ends = next((n for n, text in enumerate(names) if not text or text.startswith("#")), len(rows))
    kinds = {row["col_name"].lower(): row["data_type"] for row in rows[:ends]}
    wanted = {c: kind.lower() for c, kind in target_read_types().items()}
    narrower = {c: kinds[c] for c in wanted if c in kinds and not _holds(kinds[c], wanted[c])}
    behind = {text.lower() for text in names[ends:]}
    partitions = [c for c in (RUN, BATCH) if replaces_batches and c not in behind]
    return Differences([c for c in wanted if c not in kinds], narrower, partitions)


def reconcile_table(
    spark: SparkSession, name: str, replaces_batches: bool = False, add_columns: bool = True
) -> list[str]:
    """Makes a table that was found take target rows, or raises before any is written.

    Columns it lacks are added, empty in the rows it has; these names are returned.  Types that
    cannot hold a target's values, and partitions that are not there, are refused: values
    would be cut or batches not be replaced.
    """
    found = differences(spark, name, replaces_batches)
    if found.narrower or found.partitions or (found.missing and not add_columns):
        raise ValueError(f"{name} cannot take the target's rows: it {found.said()}")
    if found.missing:
        added = ddl({column: target_read_types()[column] for column in found.missing})
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")
    return found.missing


def append_to_table(name: str) -> WriteBatch:
    """Append to a catalog table; a text longer than its column fails the write."""

    def write(batch: DataFrame, run: str, number: int) -> None:
        batch.sparkSession.sql(
            f"INSERT INTO {name} BY NAME SELECT {', '.join(TARGET_COLUMNS)} FROM {{batch}}",
            batch=batch,
        )

    return write


def replace_in_table(name: str) -> WriteBatch:
    """Overwrite only this batch's partition of a catalog table."""

    def write(batch: DataFrame, run: str, number: int) -> None:
        batch.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {name} PARTITION ({RUN} = '{run}', {BATCH} = {int(number)}) "
            f"BY NAME SELECT {', '.join(TARGET_COLUMNS)} FROM {{batch}}",
            batch=batch,
        )

    return write


def append_to(fmt: str, **options: object) -> WriteBatch:
    """Append through any data source: files, JDBC, or a warehouse's connector."""

    def write(batch: DataFrame, run: str, number: int) -> None:
        batch.write.format(fmt).options(**options).mode("append").save()

    return write


def replace_in_folder(
    path: str, fmt: str = "parquet", by: Sequence[str] = (), **options: object
) -> WriteBatch:
    """Overwrite only this batch's folder below ``path``, with a folder per value of ``by``.

    The stream's id is part of the folder: batch numbers start again when a
    checkpoint is lost, and must not then fall on an older stream's folders.
    """

    def write(batch: DataFrame, run: str, number: int) -> None:
        folder = f"{path}/{RUN}={run}/{BATCH}={number}"
        writer = batch.write.format(fmt).options(**options).partitionBy(*by)
        writer.mode("overwrite").save(folder)

    return write
