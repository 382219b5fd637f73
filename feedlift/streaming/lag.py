"""How late posts come and how large they are, by community and over all batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.functions.epoch import utc_to_epoch
from feedlift.sinks.table import WriteBatch, replace_in_folder
from feedlift.streaming.audit import ReadBack

# Items a sketch keeps at each level: ranks are off by some one percent.
SKETCH = 200
_SKETCH_TYPES = "subreddit STRING, n_rows BIGINT, lag BINARY, size BINARY"


def sketches(rows: DataFrame) -> DataFrame:
    """``subreddit``, ``n_rows``, and sketches of lag (seconds) and size (bytes of text).

    Tasks sketch what they read and sketches are merged: a few kilobytes for each
    community, however many rows it has.  What has no time is in no sketch of lags.
    """
    lag = utc_to_epoch(F.col("kafka_timestamp")) - utc_to_epoch(F.col("created_utc"))
    size = F.octet_length("title") + F.octet_length("selftext")
    measured = rows.select("subreddit", lag.alias("lag"), size.cast("bigint").alias("size"))
    return measured.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.kll_sketch_agg_double("lag", SKETCH).alias("lag"),
        F.kll_sketch_agg_bigint("size", SKETCH).alias("size"),
    )


def with_lags(write: WriteBatch, lags: str, read_back: ReadBack | None = None) -> WriteBatch:
    """``write``, and beside it the batch's sketches below ``lags``, replaced when it runs again.

    They are made of what ``read_back`` finds of the batch in the target, or of the batch.
    """

    def write_batch(batch: DataFrame, run: str, number: int) -> int | None:
        told = write(batch, run, number)
        rows = read_back(batch.sparkSession, run, number) if read_back else batch
        replace_in_folder(lags)(sketches(rows), run, number)
        return told

    return write_batch


def distributions(
    spark: SparkSession, lags: str, quantiles: Sequence[float] = (0.5, 0.9, 0.99)
) -> DataFrame:
    """``subreddit``, ``n_rows``, and arrays ``lag`` and ``size`` of the quantiles, so far.

    NULL where nothing was measured, as the lag of messages that could not be read.
    """
    merged = spark.read.schema(_SKETCH_TYPES).parquet(lags).groupBy("subreddit").agg(
        F.sum("n_rows").alias("n_rows"),
        F.kll_merge_agg_double("lag").alias("lag"),
        F.kll_merge_agg_bigint("size").alias("size"),
    )
    at = F.array(*(F.lit(float(q)) for q in quantiles))
    lag = F.when(F.kll_sketch_get_n_double("lag") > 0, F.kll_sketch_get_quantile_double("lag", at))
    size = F.when(
        F.kll_sketch_get_n_bigint("size") > 0, F.kll_sketch_get_quantile_bigint("size", at)
    )
    return merged.select("subreddit", "n_rows", lag.alias("lag"), size.alias("size"))
