"""Time the job's steps and the headline queries; print one JSON line.

BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs after one warm-up; the median counts (default 2)
BENCH_REPEAT  how often the steps' messages hold the events table (default 20)

Steps are timed over messages that are made beforehand, in several files for each core:
each step reads, and writes or leaves out, what its name says and no more.  ``like_*`` are the
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.operators.messages import read_posts
from feedlift.operators.placement import by_key, rebalance
from feedlift.plans.feeds import events_feed
from feedlift.plans.queries import QUERIES
from feedlift.session import fresh_folder, local_session
from feedlift.sinks.table import append_to, ensure_table, replace_in_folder, replace_in_table
from feedlift.sinks.topic import PLACE, place_as_files
from feedlift.sources.topic import read_topic
from feedlift.streaming.batches import batch_writer
from feedlift.streaming.ingest import posts_to_messages
from feedlift.streaming.run import drain

HEADLINE = [
    "normalize_posts",
    "json_encode",
    "json_decode",
    "json_decode_malformed",
    "flatten_typed",
    "roundtrip_documents",
    "lineage_columns",
    "epoch_shipdates",
    "topic_publish_stream",
    "topic_publish_mixed",
    "topic_replay",
    "feed_mixed_types",
    "stream_dedup",
    "sink_merge",
    "resume_without_checkpoint",
    "offset_gaps",
    "placement_skewed",
    "ingest_lag",
    "src_stream_scan",
    "src_topic_scan",
    "src_skip_restart",
    "stream_foreach_batch",
    "stream_micro_batches",
    "stream_resume",
    "stream_rejects",
    "stream_rejects_one_pass",
    "stream_long_text",
    "sink_ensure_table",
    "batch_row_counts",
    "repartition_by_key",
    "repartition_rebalanced",
]


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def staged(spark: SparkSession, sf_dir: str, repeat: int, files: int) -> tuple[str, str]:
    """The events table ``repeat`` times over and the topic of its messages, as files."""
    work = fresh_folder(spark, "bench")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = events.agg(F.max("event_id") + 1).first()[0]
    again = F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))
    many = events.withColumn("again", again)
    many = many.withColumn("event_id", F.col("event_id") + F.col("again") * step).drop("again")
    many.repartition(files).write.parquet(f"{work}/events.parquet")
    topic = place_as_files(posts_to_messages(events_feed(spark, work), PLACE), "posts")
    topic.write.parquet(f"{work}/topic")
    return work, f"{work}/topic"


def steps(spark: SparkSession, work: str, path: str) -> dict[str, Callable[[], object]]:
    def topic(stream: bool = False) -> DataFrame:
        return read_topic(spark, "parquet", {"path": path}, stream)

    def out() -> str:
        return fresh_folder(spark, "bench-out")

    def stream(write: Callable[[DataFrame, int], None]) -> None:
        drain(topic(stream=True).transform(read_posts), write, out())

    def to_table() -> None:
        name = "bench_" + out().rsplit("-", 1)[1]
        ensure_table(spark, name, location=out(), replaces_batches=True, bounded=False)
        stream(batch_writer(replace_in_table(name)))
        spark.sql(f"DROP TABLE {name}")

    def checked_shuffled_cached(batch: DataFrame, number: int) -> None:
        """What the job avoids: a look for rows, a shuffle into six, a cache, a count, a write."""
        if batch.isEmpty():
            return
        placed = batch.repartition(6, "subreddit").cache()
        placed.count()
        append_to("parquet", path=out())(placed, "bench", number)
        placed.unpersist()

    six = by_key("subreddit", 6, salts=1)
    return {
        "normalize": lambda: noop(events_feed(spark, work)),
        "normalize_encode": lambda: noop(posts_to_messages(events_feed(spark, work))),
        "decode_flatten": lambda: noop(topic().transform(read_posts)),
        "decode_place_six": lambda: (
            topic().transform(read_posts).transform(six).write.parquet(out())
        ),
        "stream_folder": lambda: stream(batch_writer(replace_in_folder(out()))),
        "stream_folder_rebalanced": lambda: stream(
            batch_writer(replace_in_folder(out()), rebalance())
        ),
        "stream_table": to_table,
        "stream_shuffled_cached": lambda: stream(checked_shuffled_cached),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    repeat = int(os.environ.get("BENCH_REPEAT", "20"))
    spark = local_session(cpus, "bench")

    def timed(action: Callable[[], object]) -> float:
        def once() -> float:
            began = time.perf_counter()
            action()
            return time.perf_counter() - began

        once()
        return round(statistics.median(once() for _ in range(runs)), 3)

    seconds = {}
    for prefix, times, files in (("like", 1, 2), ("step", repeat, 4 * int(cpus))):
        for name, action in steps(spark, *staged(spark, sf_dir, times, files)).items():
            seconds[f"{prefix}_{name}"] = timed(action)
    for name in HEADLINE:
        seconds[name] = timed(lambda name=name: noop(QUERIES[name](spark, sf_dir)))
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "steps and headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
                "messages": {"like": "events once", "step": f"events {repeat} times"},
            }
        )
    )


if __name__ == "__main__":
    main()
