"""Starting, draining and resuming streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from feedlift.sources.named import NamedStream, Stream

# Keyword arguments of ``DataStreamWriter.trigger``.
Trigger = Mapping[str, object]
ALL_NOW: Trigger = {"availableNow": True}


def with_trigger(writer: DataStreamWriter, trigger: Trigger | None) -> DataStreamWriter:
    """Without a trigger, each batch starts as soon as the one before has ended."""
    return writer.trigger(**trigger) if trigger else writer


def start_batches(
    rows: Stream,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: Trigger | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Hand each micro-batch to ``write_batch``; progress lives in ``checkpoint``.

    Started again with the same checkpoint, the stream goes on after the last
    batch it committed.  Keep the checkpoint on storage that outlives the driver.
    """
    if isinstance(rows, NamedStream):
        rows, write_batch = rows.names, rows.over(write_batch)
    writer = rows.writeStream.foreachBatch(write_batch).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return with_trigger(writer, trigger).start()


def drain(
    rows: Stream, write_batch: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Run until all that is there now is written, then return the ended stream."""
    query = start_batches(rows, write_batch, checkpoint, ALL_NOW)
    query.awaitTermination()
    return query


def _last_file(spark: SparkSession, folder: str) -> int:
    """The largest number that names a file below ``folder``; -1 if there is none."""
    try:
        files = spark.read.format("binaryFile").load(folder).select("path")
        name = F.element_at(F.split("path", "/"), -1).try_cast("bigint")
        return files.agg(F.coalesce(F.max(name), F.lit(-1))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def has_progress(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream with this checkpoint has ever committed a batch."""
    return _last_file(spark, f"{checkpoint}/commits") >= 0


def _marked(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("done INT").json(path).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _mark(spark: SparkSession, path: str) -> None:
    spark.sql("SELECT 1 AS done").write.mode("overwrite").json(path)


class _BehindSkip(Exception):
    """A batch that is not the skip's: the stream itself will write it."""


def skip_existing(rows: Stream, checkpoint: str) -> None:
    """Record all that is there at the first start as seen, so that the stream starts behind it.

    The decision is kept with the checkpoint: ``skip_begun`` and ``skip_done`` beside Spark's
    own folders.  Once it is done nothing is skipped again, also where there was
    nothing to skip, or where a first batch was planned and never written.  A skip
    that was lost half way is finished, and takes only the batches it had planned; what
    came since is left to the stream, which also runs the batch that may be planned
    for it.  A checkpoint that a stream without a skip has used is left as it is.

    Read ``rows`` without a bound, for one batch that is committed without being
    read; the cost is that of listing the source.  Kafka has ``startingOffsets`` instead.
    """
    if isinstance(rows, NamedStream):
        rows = rows.names
    spark = rows.sparkSession
    begun, done = f"{checkpoint}/skip_begun", f"{checkpoint}/skip_done"
    if _marked(spark, done):
        return
    planned = _last_file(spark, f"{checkpoint}/offsets")
    again = _marked(spark, begun)
    if planned >= 0 and not again:
        return
    _mark(spark, begun)

    def skip(batch: DataFrame, number: int) -> None:
        if again and number > planned:
            raise _BehindSkip(f"batch {number} is behind the skip")

    try:
        if not again or planned >= 0:
            drain(rows, skip, checkpoint)
    except StreamingQueryException as ended:
        if _BehindSkip.__name__ not in str(ended):
            raise
    _mark(spark, done)
