"""Placement by measured sizes, sketches of lag, and batches split once for two targets."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Observation, functions as F

from conftest import SMALL
from feedlift.operators.messages import read_posts
from feedlift.operators.placement import Measured, by_share
from feedlift.plans.feeds import FEEDS, events_feed
from feedlift.sinks.table import replace_in_folder
from feedlift.sinks.topic import PLACE, place_as_files, write_topic
from feedlift.sources.topic import read_topic
from feedlift.streaming.batches import batch_writer, splitting_writer
from feedlift.streaming.ingest import posts_to_messages
from feedlift.streaming.lag import distributions, sketches, with_lags
from feedlift.streaming.run import drain

N = 40_000


@pytest.fixture
def work(tmp_path):
    return str(tmp_path)


@pytest.fixture
def skewed(spark):
    """Four in ten rows of one key, one in ten of none, the others of five hundred."""
    key = F.when(F.col("id") % 10 < 4, F.lit("hot"))
    key = key.when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
    return spark.range(N).select(
        key.alias("subreddit"),
        (F.col("id") % 3).cast("int").alias("kafka_partition"),
        F.call_function("div", "id", F.lit(3)).alias("kafka_offset"),
    )


def places(df):
    rows = df.withColumn("place", F.spark_partition_id()).groupBy("subreddit", "place").count()
    return {(row[0], row[1]): row[2] for row in rows.collect()}


def sums(found, which):
    out = {}
    for key, n in found.items():
        out[key[which]] = out.get(key[which], 0) + n
    return out


def learned(spread, df):
    """What the spread measures while ``df`` is written."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *spread.measures())
    rows.write.format("noop").mode("overwrite").save()
    spread.learn(seen.get)
    return spread


@pytest.mark.parametrize("partitions", [4, 24, 100])
def test_no_partition_is_twice_the_mean(skewed, partitions):
    spread = learned(Measured("subreddit", partitions), skewed)
    assert spread.shares["hot"] == 0.4 and spread.shares[None] == 0.1
    out = spread(skewed)
    assert out.columns == skewed.columns
    found = places(out)
    assert sum(found.values()) == N
    assert max(sums(found, 1).values()) <= 2 * N / partitions
    light = [key for key, _ in found if key not in ("hot", None)]
    assert len(light) == len(set(light))


def test_rows_have_the_same_places_again(skewed):
    spread = by_share("subreddit", {"hot": 0.4, None: 0.1}, 16)
    assert places(spread(skewed)) == places(spread(skewed.repartition(7)))


@pytest.mark.parametrize("shares", [{}, {"hot": 1.0}, {"gone": 0.9, "hot": 0.4}, {"k1": 0.001}])
def test_shares_that_are_off_lose_no_row(skewed, shares):
    found = places(by_share("subreddit", shares, 12)(skewed))
    assert sum(found.values()) == N
    assert {place for _, place in found} <= set(range(12))


def test_the_first_batch_is_salted_and_an_empty_one_measures_nothing(skewed):
    spread = Measured("subreddit", 12)
    assert sum(places(spread(skewed)).values()) == N
    assert not learned(spread, skewed.where("false")).shares
    learned(spread, skewed)
    assert learned(spread, skewed.where("false")).shares


def envelope(spark, feed="documents"):
    return place_as_files(posts_to_messages(FEEDS[feed](spark, SMALL), PLACE), "posts")


def test_sketches_of_batches_are_those_of_all_rows(spark, work):
    write = with_lags(replace_in_folder(f"{work}/out"), f"{work}/lags")
    rows = envelope(spark).transform(read_posts)
    for number in range(3):
        for _ in range(2):
            write(rows.where(F.col("kafka_partition") == number), "run", number)
    # Few rows are held whole, so that quantiles are values that are there.
    found = {r.subreddit: r for r in distributions(spark, f"{work}/lags", (0.0, 1.0)).collect()}
    lag = F.unix_seconds(F.col("kafka_timestamp").cast("timestamp")) - F.unix_seconds(
        F.col("created_utc").cast("timestamp")
    )
    want = rows.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n"), F.min(lag).alias("low"), F.max(lag).alias("high")
    )
    for row in want.collect():
        got = found[row.subreddit]
        assert got.n_rows == row.n and got.lag == [row.low, row.high]


def test_what_has_no_time_has_no_lag(spark, work):
    rows = envelope(spark).withColumn("value", F.lit(b"junk")).transform(read_posts)
    replace_in_folder(f"{work}/lags")(sketches(rows), "run", 0)
    got = distributions(spark, f"{work}/lags").collect()
    assert [(r.subreddit, r.n_rows, r.lag, r.size) for r in got] == [(None, 200, None, None)]


def test_a_split_batch_reads_its_source_once_and_keeps_nothing(spark, work):
    options = {"path": f"{work}/topic"}
    write_topic(envelope(spark, "events").repartition(4), "parquet", options)
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    flagged = read_topic(spark, "parquet", options).withColumn(
        "reject_reason", F.expr("IF(partition = 0, 'zero', NULL)")
    )
    splitter = splitting_writer(
        replace_in_folder(f"{work}/out"),
        replace_in_folder(f"{work}/rejects"),
        lambda good: good,
        staging=f"{work}/staged",
    )
    kept = []

    def watched(batch, number):
        splitter(seen(batch), number)
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size())

    drain(flagged, watched, f"{work}/checkpoint")
    assert read.value == 1000 and kept == [0]
    out, aside = spark.read.parquet(f"{work}/out"), spark.read.parquet(f"{work}/rejects")
    assert out.count() + aside.count() == 1000
    assert out.where("partition = 0").isEmpty() and aside.where("partition != 0").isEmpty()
    assert os.listdir(f"{work}/staged") == []


def test_what_a_lost_split_staged_is_replaced(spark, work):
    rows = events_feed(spark, SMALL).withColumn("reject_reason", F.lit(None).cast("string"))
    rows.coalesce(1).write.parquet(f"{work}/feed")
    stream = spark.readStream.schema(rows.schema).parquet(f"{work}/feed")
    failures = iter([True])

    def write(batch, run, number):
        if next(failures, False):
            raise RuntimeError("no disk")
        replace_in_folder(f"{work}/out")(batch, run, number)

    splitter = splitting_writer(
        write, replace_in_folder(f"{work}/rejects"), lambda good: good, staging=f"{work}/staged"
    )
    with pytest.raises(StreamingQueryException, match="no disk"):
        drain(stream, splitter, f"{work}/checkpoint")
    drain(stream, splitter, f"{work}/checkpoint")
    assert spark.read.parquet(f"{work}/out").count() == 1000
    assert spark.read.parquet(f"{work}/rejects").isEmpty()


def test_a_stream_learns_from_batch_to_batch(spark, work, skewed):
    for number in range(2):
        skewed.withColumn("n", F.lit(number)).coalesce(1).write.mode("append").parquet(
            f"{work}/feed"
        )
    stream = spark.readStream.schema("subreddit STRING, kafka_partition INT, kafka_offset BIGINT")
    spread, seen = Measured("subreddit", 10), []

    def write(batch, run, number):
        seen.append(dict(spread.shares))
        batch.write.format("noop").mode("overwrite").save()

    feed = stream.option("maxFilesPerTrigger", 1).parquet(f"{work}/feed")
    drain(feed, batch_writer(write, spread), f"{work}/checkpoint")
    assert seen[0] == {} and seen[1]["hot"] == 0.4
