"""Where rows go: hot keys split, nothing lost, the same place after a rerun."""

import pytest
from pyspark.sql import functions as F

from feedlift.operators.placement import by_key, rebalance, salt, salts_for


@pytest.fixture
def skewed(spark):
    """30,000 rows, more than a third of them of one key and some of none."""
    key = F.when(F.col("id") % 10 < 4, F.lit("hot"))
    key = key.when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
    return spark.range(30_000).select(
        key.alias("subreddit"),
        (F.col("id") % 3).cast("int").alias("kafka_partition"),
        F.call_function("div", "id", F.lit(3)).alias("kafka_offset"),
    )


def sizes(df, *keys):
    """Rows per key and partition."""
    placed = df.withColumn("place", F.spark_partition_id())
    counts = placed.groupBy(*keys, "place").count().collect()
    return {tuple(row[:-1]): row["count"] for row in counts}


def test_without_salts_a_key_is_in_one_partition(skewed):
    places = sizes(skewed.transform(by_key("subreddit", 6, salts=1)), "subreddit")
    keys = [key for key, _ in places]
    assert len(keys) == len(set(keys)) == skewed.select("subreddit").distinct().count()
    assert {place for _, place in places} <= set(range(6))
    assert sum(places.values()) == 30_000


@pytest.mark.parametrize("partitions", [None, 64])
def test_hot_and_missing_keys_are_split(skewed, partitions):
    places = sizes(skewed.transform(by_key("subreddit", partitions, salts=8)), "subreddit")
    assert sum(places.values()) == 30_000
    for key in {key for key, _ in places}:
        assert sum(1 for k, _ in places if k == key) <= 8
    if partitions:
        for key in ("hot", None):
            shares = [n for (k, _), n in places.items() if k == key]
            assert len(shares) > 4
            # An even share is an eighth; two salts may meet in one partition.
            assert max(shares) <= sum(shares) * 3 / 8


@pytest.mark.parametrize(("partitions", "salts"), [(1, 1), (6, 2), (8, 3), (3000, 1000)])
def test_salts_grow_with_partitions(spark, skewed, partitions, salts):
    assert salts_for(skewed, partitions) == salts
    assert salts_for(skewed) == salts_for(skewed, 8)


def test_by_default_the_hot_key_makes_no_large_partition(skewed):
    """40% of all rows are hot; each partition has its share of them and of the rest."""
    places = sizes(skewed.transform(by_key("subreddit", 48)))
    assert sum(places.values()) == 30_000
    assert max(places.values()) <= 4 * 30_000 / 48


def test_salts_are_even_and_repeatable(skewed):
    columns = ["kafka_partition", "kafka_offset"]
    salted = skewed.withColumn("salt", salt(columns, 8))
    hot = salted.where("subreddit = 'hot'").groupBy("salt").count().collect()
    counts = [row["count"] for row in hot]
    assert len(counts) == 8 and max(counts) <= 1.2 * min(counts)
    again = skewed.repartition(3).withColumn("salt", salt(columns, 8))
    assert salted.exceptAll(again).isEmpty()


def test_a_key_with_a_rhythm_is_split_too(spark):
    """Offsets that share a remainder still get all salts."""
    df = spark.range(8000).select((F.col("id") * 16).alias("offset"))
    counts = df.groupBy(salt(["offset"], 8)).count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 1200


def test_missing_lineage_has_a_salt_too(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS p, CAST(NULL AS BIGINT) AS o")
    assert df.select(salt(["p", "o"], 8)).first()[0] in range(8)


def test_same_rows_in_the_same_place_each_time(skewed):
    spread = by_key("subreddit", 16)
    one, other = (sizes(skewed.transform(spread), "subreddit", "kafka_offset") for _ in range(2))
    assert one == other


@pytest.mark.parametrize("columns", [(), ("subreddit",)])
def test_rebalance_keeps_rows(skewed, columns):
    assert skewed.transform(rebalance(*columns)).exceptAll(skewed).isEmpty()
    assert skewed.transform(rebalance(*columns)).count() == 30_000


def test_rebalance_splits_a_hot_key(spark, skewed, tmp_path):
    """With small targets, no file holds the hot key whole."""
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16kb",
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.5",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        wide = skewed.repartition(8).withColumn("pad", F.uuid())
        wide.transform(rebalance("subreddit")).write.parquet(str(tmp_path / "out"))
    finally:
        for name in settings:
            spark.conf.unset(name)
    files = (
        spark.read.parquet(str(tmp_path / "out"))
        .where("subreddit = 'hot'")
        .groupBy(F.input_file_name())
        .count()
        .collect()
    )
    assert len(files) > 1
    assert sum(row["count"] for row in files) == 12_000
