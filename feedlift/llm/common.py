"""Steps that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlift.session import fresh_folder

# Rows of an Arrow batch that are Python objects at one time.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a table in the folder that all executors share.

    Cuts the lineage: what comes after it does not compute it again, nor when an
    executor is lost.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(name: str = "text") -> Column:
    """Tells apart rows that share an id; equal rows stay equal."""
    return F.xxhash64(F.col(name))


def crc_of_id(name: str = "doc_id") -> Column:
    """CRC-32 of an id as text; NULL for a missing id."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def packed(docs: DataFrame, *needed: str, more: Sequence[Column] = ()) -> DataFrame:
    """``needed`` columns, ``more`` ones, and all others in one column, ``others``.

    So an operator may name its own columns as it likes, whatever the others are called.
    """
    others = [F.col(f"`{name}`") for name in docs.columns if name not in needed]
    others = F.struct(*others or [F.lit(None).alias("none")])
    return docs.select(*needed, *more, others.alias("others"))


def unpacked(df: DataFrame, names: Sequence[str], *needed: str) -> DataFrame:
    """The columns ``names`` of what :func:`packed` has packed, ``needed`` as they now are."""
    # Generated, not extracted: the optimizer must not take the column apart further down.
    rows = df.select(*needed, F.inline(F.array("others")))
    return rows.select(*(f"`{name}`" for name in names))


def map_slices(
    df: DataFrame, function: Callable[[list[dict]], pa.RecordBatch], schema: str
) -> DataFrame:
    """Rows through ``function`` a few at a time, inside the tasks that hold them.

    Only a slice of a batch is Python objects at one time, so that long texts
    are not all held twice.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield function(batch.slice(start, SLICE_ROWS).to_pylist())

    return df.mapInArrow(over, schema)


def sampled(rows: DataFrame, most: int, of: int, *keys: str) -> DataFrame:
    """About ``most`` of ``of`` rows, chosen by a hash of ``keys``, the same every time."""
    if of <= most:
        return rows
    place = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1_000_000))
    return rows.where(place < int(1_000_000 * most / of))
