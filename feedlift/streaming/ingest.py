"""The two jobs: posts to a topic, and a topic to a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlift.operators.messages import encode_messages, read_posts, read_posts_flagged
from feedlift.operators.normalize import flag_unusable, normalize_posts
from feedlift.operators.placement import Spread
from feedlift.sinks.table import (
    WriteBatch,
    append_to_table,
    bounded_columns,
    ensure_table,
    reconcile_table,
    replace_in_folder,
    replace_in_table,
)
from feedlift.sources.named import Stream
from feedlift.streaming.batches import batch_writer, splitting_writer
from feedlift.streaming.run import Trigger, start_batches


def posts_to_messages(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw posts to message values, plus the columns in ``keep``."""
    return raw.transform(normalize_posts, keep).transform(encode_messages, keep)


def start_publish(
    raw: Stream,
    checkpoint: str,
    write: WriteBatch,
    write_rejects: WriteBatch,
    to_messages: Callable[[DataFrame], DataFrame] = posts_to_messages,
    trigger: Trigger | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Send a feed's posts to a topic, and posts that lack a required number aside.

    Where those need not be set aside, ``stream_topic`` on
    :func:`posts_to_messages` is simpler: it sends nulls for what a post lacks.
    """
    splitter = splitting_writer(write, write_rejects, to_messages, staging=f"{checkpoint}/staged")
    return start_batches(raw.transform(flag_unusable), splitter, checkpoint, trigger, name)


def start_ingest(
    envelope: Stream,
    checkpoint: str,
    write: WriteBatch,
    write_rejects: WriteBatch | None = None,
    prepare: Callable[[], None] | None = None,
    spread: Spread | None = None,
    trigger: Trigger | None = None,
    skip_empty: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Decode, type and write a topic, batch by batch.

    ``prepare`` runs first, and if it fails the stream does not start: that is
    the place for creating the target.  With ``write_rejects``, messages that
    cannot be read or do not fit the target go there, else every message is a
    row of the target.
    """
    if prepare:
        prepare()
    if write_rejects is None:
        writer = batch_writer(write, spread, skip_empty=skip_empty)
        return start_batches(envelope.transform(read_posts), writer, checkpoint, trigger, name)
    splitter = splitting_writer(
        write,
        write_rejects,
        lambda df: df.drop("reject_reason", "raw_value"),
        spread,
        staging=f"{checkpoint}/staged",
        skip_empty=skip_empty,
    )
    flagged = envelope.transform(read_posts_flagged)
    return start_batches(flagged, splitter, checkpoint, trigger, name)


def start_folder_ingest(
    envelope: Stream,
    path: str,
    checkpoint: str,
    spread: Spread | None = None,
    trigger: Trigger | None = None,
    skip_empty: bool = False,
    name: str | None = None,
    around: Callable[[WriteBatch], WriteBatch] = lambda write: write,
) -> StreamingQuery:
    """All messages to one folder, rows below ``outcome=row``, others ``outcome=reject``.

    One pass and nothing staged in between, as two targets need it.  A reader that
    filters on ``outcome`` opens only the files it needs.
    """
    flagged = envelope.transform(read_posts_flagged)
    outcome = F.when(F.col("reject_reason").isNull(), "row").otherwise("reject")
    write = around(replace_in_folder(path, by=["outcome"]))
    writer = batch_writer(write, spread, skip_empty=skip_empty)
    rows = flagged.transform(lambda df: df.withColumn("outcome", outcome))
    return start_batches(rows, writer, checkpoint, trigger, name)


def start_table_ingest(
    spark: SparkSession,
    envelope: Stream,
    table: str,
    checkpoint: str,
    exact: bool = True,
    provider: str | None = "parquet",
    location: str | None = None,
    bounded: bool = False,
    add_columns: bool = True,
    around: Callable[[WriteBatch], WriteBatch] = lambda write: write,
    **how: object,
) -> StreamingQuery:
    """:func:`start_ingest` into a catalog table, created first if need be.

    A new table takes texts of any length, unless ``bounded`` gives its columns the
    target's lengths.  One text beyond them would stop the job, again at every
    restart: with a bounded table, new or found there, ``write_rejects`` must say
    where such messages go, or the stream does not start.

    A table that is found is held against the target first: columns it lacks are added, unless
    ``add_columns`` is off, and one that cannot hold the target's values is refused.

    ``around`` may put a writer around that of the table, for what is kept beside it.

    ``exact`` makes a batch that runs twice replace itself, at the price of a
    partition per batch.  Without it rows are appended, at least once each.
    A session that read the table before must ``REFRESH TABLE`` to see more:
    the stream writes in a session of its own.
    """

    def prepare() -> None:
        ensure_table(spark, table, provider, location, replaces_batches=exact, bounded=bounded)
        reconcile_table(spark, table, exact, add_columns)
        if how.get("write_rejects") is None and (columns := bounded_columns(spark, table)):
            raise ValueError(
                f"{table} bounds the texts of {', '.join(columns)}: say where longer ones go"
            )

    write = replace_in_table(table) if exact else append_to_table(table)
    return start_ingest(envelope, checkpoint, around(write), prepare=prepare, **how)
