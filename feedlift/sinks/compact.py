"""Many small batches of an exact table, kept as few large files.

A table that replaces batches has a partition for each.  Closed ones, which no stream will
write again, are copied into a partition of an archive beside the table.  That
partition appears in the catalog in one step, and :func:`read_whole` passes over
batches of the table that an archived range covers: so every row is there once,
wherever a compaction is interrupted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.schema import TARGET_COLUMNS, ddl, target_read_types
from feedlift.sinks.table import BATCH, RUN

FIRST, LAST = "first_batch", "last_batch"


def archive_of(table: str) -> str:
    return f"{table}_archive"


def ensure_archive(spark: SparkSession, table: str) -> None:
    types = target_read_types() | {RUN: "STRING", FIRST: "BIGINT", LAST: "BIGINT"}
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {archive_of(table)} ({ddl(types)}) "
        f"USING parquet PARTITIONED BY ({RUN}, {FIRST}, {LAST})"
    )


def _partitions(spark: SparkSession, table: str, run: str | None = None) -> list[dict[str, str]]:
    """The partitions of one run, or of all, from the catalog: a few numbers for each."""
    of = f" PARTITION ({RUN} = '{run}')" if run else ""
    rows = spark.sql(f"SHOW PARTITIONS {table}{of}").collect()
    return [dict(part.split("=", 1) for part in row[0].split("/")) for row in rows]


def _ranges(spark: SparkSession, table: str, run: str) -> list[tuple[int, int]]:
    return [(int(p[FIRST]), int(p[LAST])) for p in _partitions(spark, archive_of(table), run)]


def runs_of(spark: SparkSession, table: str) -> dict[str, int]:
    """The streams that have written to the table, and the last batch of each that is there."""
    found: dict[str, int] = {}
    for part in _partitions(spark, table):
        found[part[RUN]] = max(int(part[BATCH]), found.get(part[RUN], -1))
    return found


def copy_batches(spark: SparkSession, table: str, run: str, last: int, folder: str) -> bool:
    """Closed batches of ``run`` up to ``last`` into the archive, as one partition below ``folder``.

    Files are sized by adaptive execution.  A copy that is interrupted leaves files
    that no partition names.
    """
    ensure_archive(spark, table)
    done = max((end for _, end in _ranges(spark, table, run)), default=-1)
    batches = sorted(int(p[BATCH]) for p in _partitions(spark, table, run))
    batches = [batch for batch in batches if done < batch <= last]
    if not batches:
        return False
    path = f"{folder.rstrip('/')}/{run}-{batches[0]}-{batches[-1]}-{uuid.uuid4().hex}"
    closed = (F.col(RUN) == run) & F.col(BATCH).between(batches[0], batches[-1])
    rows = spark.table(table).where(closed)
    rows.select(TARGET_COLUMNS).hint("rebalance").write.parquet(path)
    spark.sql(
        f"ALTER TABLE {archive_of(table)} ADD PARTITION ({RUN} = '{run}', "
        f"{FIRST} = {batches[0]}, {LAST} = {batches[-1]}) LOCATION '{path}'"
    )
    return True


def drop_copied(spark: SparkSession, table: str, run: str) -> None:
    """Drops the batches that the archive has; again harmlessly after an interruption."""
    ranges = _ranges(spark, table, run)
    for part in _partitions(spark, table, run):
        batch = int(part[BATCH])
        if any(first <= batch <= last for first, last in ranges):
            named = f"{RUN} = '{run}', {BATCH} = {batch}"
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({named})")


def compact(spark: SparkSession, table: str, run: str, last: int, folder: str) -> None:
    """Archives closed batches, and finishes a compaction that was interrupted."""
    ensure_archive(spark, table)
    drop_copied(spark, table, run)
    if copy_batches(spark, table, run, last, folder):
        drop_copied(spark, table, run)


def read_whole(spark: SparkSession, table: str) -> DataFrame:
    """Every row once: the archive, and the batches of the table that it does not have.

    What the archive has is asked of the catalog; its files are not opened for that.
    """
    archive = spark.table(archive_of(table))
    parts = _partitions(spark, archive_of(table))
    ranges = [(part[RUN], int(part[FIRST]), int(part[LAST])) for part in parts]
    held = spark.createDataFrame(ranges, "_run STRING, _first BIGINT, _last BIGINT")
    met = (F.col(RUN) == F.col("_run")) & F.col(BATCH).between(F.col("_first"), F.col("_last"))
    rest = spark.table(table).join(held, met, "left_anti")
    return rest.select(TARGET_COLUMNS).unionByName(archive.select(TARGET_COLUMNS))
