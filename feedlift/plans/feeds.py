"""Feeds of raw posts, derived row by row from the given tables.

Besides a raw post's ten columns each has those of ``PLACE``, which stand
for what a broker would assign.  Some texts and
authors are left out by a rule on the id, since the tables hold no NULLs.  The
same expressions serve batch and stream; no step depends on the session zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlift.functions.epoch import utc_to_epoch, utc_to_instant
from feedlift.sources.feed import one_table, read_feed

PARTITIONS = 3
START = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A given table, whole.  Its schema comes from one file footer."""
    path = f"{sf_dir}/{name}.parquet"
    if not stream:
        return spark.read.parquet(path)
    schema = spark.read.parquet(path).schema
    return read_feed(spark, one_table(sf_dir, f"{name}.parquet"), schema)


def _unless(every: int, number: Column, value: Column) -> Column:
    return F.when(number % every != 0, value)


def _placed(number: Column, timestamp: Column) -> list[Column]:
    return [
        (number % PARTITIONS).cast("int").alias("partition"),
        F.call_function("div", number, F.lit(PARTITIONS)).alias("offset"),
        timestamp.alias("timestamp"),
    ]


def _posts(
    df: DataFrame,
    number: Column,
    id: Column,
    title: Column,
    author: Column,
    subreddit: Column,
    score: Column,
    upvote_ratio: Column,
    num_comments: Column,
    created_utc: Column,
    url: Column,
    selftext: Column,
    timestamp: Column,
) -> DataFrame:
    return df.select(
        id.alias("id"),
        _unless(5, number, title).alias("title"),
        _unless(7, number, author).alias("author"),
        subreddit.alias("subreddit"),
        score.alias("score"),
        upvote_ratio.alias("upvote_ratio"),
        num_comments.alias("num_comments"),
        created_utc.alias("created_utc"),
        _unless(11, number, url).alias("url"),
        selftext.alias("selftext"),
        *_placed(number, timestamp),
    )


def events_feed(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    number, kind = F.col("event_id"), F.col("event_type")
    return _posts(
        table(spark, sf_dir, "events", stream),
        number=number,
        id=number.cast("string"),
        title=kind,
        author=F.concat(F.lit("u"), F.col("user_id").cast("string")),
        subreddit=kind,
        score=F.col("value"),
        upvote_ratio=F.col("value") / 100,
        num_comments=F.col("user_id"),
        created_utc=utc_to_epoch(F.col("ts")),
        url=F.concat(F.lit("https://example.com/"), number.cast("string")),
        selftext=F.col("props"),
        timestamp=utc_to_instant(F.col("ts")),
    )


def documents_feed(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    number, size = F.col("doc_id"), F.col("n_chars").cast("double")
    return _posts(
        table(spark, sf_dir, "documents", stream),
        number=number,
        id=F.concat(F.lit("d"), number.cast("string")),
        title=F.col("source"),
        author=F.col("lang"),
        subreddit=F.col("source"),
        score=size / 7,
        upvote_ratio=size / 100_000,
        num_comments=number,
        created_utc=START + number * 0.5,
        url=F.concat(F.lit("https://example.com/d/"), number.cast("string")),
        selftext=F.col("text"),
        timestamp=F.timestamp_seconds(START + number),
    )


def pages_feed(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    number, size = F.col("page_id"), F.char_length("html").cast("double")
    return _posts(
        table(spark, sf_dir, "pages", stream),
        number=number,
        id=F.concat(F.lit("p"), number.cast("string")),
        title=F.col("url"),
        author=F.lit("crawler"),
        subreddit=F.lit("pages"),
        score=-size / 7,
        upvote_ratio=size / 100_000,
        num_comments=number,
        created_utc=START + number * 0.25,
        url=F.col("url"),
        selftext=F.col("html"),
        timestamp=F.timestamp_seconds(START + number),
    )


def conversations_feed(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    number = F.col("conv_id") * 1000 + F.col("turn")
    size = F.char_length("text").cast("double")
    return _posts(
        table(spark, sf_dir, "conversations", stream),
        number=number,
        id=F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        title=F.col("role"),
        author=F.col("role"),
        subreddit=F.col("role"),
        score=size,
        upvote_ratio=size / 100_000,
        num_comments=F.col("turn"),
        created_utc=START + number * 0.5,
        url=F.concat(F.lit("https://example.com/c/"), F.col("conv_id").cast("string")),
        selftext=F.col("text"),
        timestamp=F.timestamp_seconds(START + number),
    )


FEEDS: dict[str, Callable[..., DataFrame]] = {
    "events": events_feed,
    "documents": documents_feed,
    "pages": pages_feed,
    "conversations": conversations_feed,
}
