"""Which offsets of a topic's partitions are there, as ranges without a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

PARTITION, OFFSET = "kafka_partition", "kafka_offset"
# Offsets that one task puts in order: a partition with a third of all messages is many of these.
STRETCH = 1_000_000
# Offsets whose ranges a row is held against: half as many ranges at most.
NEAR = 1_024

RANGE_TYPES = {PARTITION: "INT", "first": "BIGINT", "last": "BIGINT"}


def _islands(rows: DataFrame, by: Sequence[str], first: str, last: str) -> DataFrame:
    """Ranges that touch or overlap, as one; rows of ``by`` are put in order in one task."""
    ordered = Window.partitionBy(*by).orderBy(first)
    before = F.max(last).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col(first) > before + 1).cast("int"), F.lit(1))
    numbered = rows.withColumn("_begins", begins)
    numbered = numbered.withColumn("_island", F.sum("_begins").over(ordered))
    found = numbered.groupBy(*by, "_island")
    found = found.agg(F.min(first).alias("first"), F.max(last).alias("last"))
    return found.drop("_island")


def ranges(
    rows: DataFrame, partition: str = PARTITION, offset: str = OFFSET, stretch: int = STRETCH
) -> DataFrame:
    """``kafka_partition``, ``first`` and ``last`` of every range of offsets that is there.

    Offsets may repeat; rows without a place are passed over.  One shuffle by partition and
    stretch of offsets; what is left then is a row for each stretch and gap.
    """
    places = rows.select(
        F.col(partition).cast("int").alias(PARTITION), F.col(offset).cast("bigint").alias("at")
    ).where(F.col(PARTITION).isNotNull() & F.col("at").isNotNull())
    places = places.withColumn("stretch", F.floor(F.col("at") / stretch).cast("bigint"))
    return merged(_islands(places, (PARTITION, "stretch"), "at", "at"))


def merged(found: DataFrame) -> DataFrame:
    """Ranges of several batches or stretches as few as they can be."""
    rows = found.select(PARTITION, "first", "last")
    return _islands(rows, (PARTITION,), "first", "last").select(PARTITION, "first", "last")


def gaps(found: DataFrame) -> DataFrame:
    """``kafka_partition``, ``first``, ``last`` and ``n_missing`` of what lies between ranges."""
    ordered = Window.partitionBy(PARTITION).orderBy("first")
    after = F.lead("first").over(ordered)
    rows = merged(found).withColumn("after", after).where("after IS NOT NULL")
    rows = rows.select(
        PARTITION, (F.col("last") + 1).alias("first"), (F.col("after") - 1).alias("last")
    )
    return rows.withColumn("n_missing", F.col("last") - F.col("first") + 1)


def by_stretch(found: DataFrame, stretch: int = NEAR) -> DataFrame:
    """Ranges as ``_partition``, ``_stretch``, ``_first``, ``_last``: a row wherever they reach."""
    reach = F.sequence(
        F.floor(F.col("first") / stretch).cast("bigint"),
        F.floor(F.col("last") / stretch).cast("bigint"),
    )
    return found.select(
        F.col(PARTITION).alias("_partition"),
        F.explode(reach).alias("_stretch"),
        F.col("first").alias("_first"),
        F.col("last").alias("_last"),
    )


def outside(
    rows: DataFrame,
    found: DataFrame,
    partition: str = PARTITION,
    offset: str = OFFSET,
    stretch: int = NEAR,
) -> DataFrame:
    """Rows whose offset is in none of the ranges; all those without a place.

    Ranges are listed for each stretch they reach into, so that the join is one on equal
    partitions and stretches.  A row meets all ranges of its stretch, which is short for that:
    half as many as it has offsets, at most, however many ranges there are.
    """
    met = (
        (rows[partition] == F.col("_partition"))
        & (F.floor(rows[offset] / stretch).cast("bigint") == F.col("_stretch"))
        & rows[offset].between(F.col("_first"), F.col("_last"))
    )
    return rows.join(by_stretch(found, stretch), met, "left_anti")
