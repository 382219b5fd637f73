"""Wire records to messages, and messages to typed target rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from feedlift.functions.codec import CORRUPT, decode_record, encode_record
from feedlift.functions.epoch import epoch_to_timestamp, instant_to_utc
from feedlift.schema import LINEAGE_COLUMNS, TARGET_COLUMNS, WIRE_COLUMNS, length_limits


def encode_messages(
    wire: DataFrame, keep: Sequence[str] = (), ascii_only: bool = False
) -> DataFrame:
    """A ``value`` column of message bytes, plus the columns in ``keep``."""
    return wire.select(encode_record(ascii_only=ascii_only).alias("value"), *keep)


def with_lineage(envelope: DataFrame) -> DataFrame:
    """Message bytes with where and when the topic stored them."""
    return envelope.select(
        "value",
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )


def decode_messages(messages: DataFrame, keep_corrupt: bool = False) -> DataFrame:
    """Add the decoded record as one struct column, ``json``; no row is dropped."""
    return messages.withColumn("json", decode_record(F.col("value"), keep_corrupt))


def flatten_posts(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Decoded records and lineage as the thirteen typed target columns."""
    derived = {
        "created_utc": epoch_to_timestamp(F.col("json.created_utc")),
        "kafka_timestamp": instant_to_utc(F.col("kafka_timestamp")),
    }
    plain = {c: F.col(f"json.{c}") for c in WIRE_COLUMNS} | {c: F.col(c) for c in LINEAGE_COLUMNS}
    columns = plain | derived
    return decoded.select(*(columns[c].alias(c) for c in TARGET_COLUMNS), *keep)


def read_posts(envelope: DataFrame) -> DataFrame:
    """Topic envelope to target rows.  One narrow stage: no shuffle, no Python."""
    return envelope.transform(with_lineage).transform(decode_messages).transform(flatten_posts)


def read_posts_flagged(envelope: DataFrame) -> DataFrame:
    """Target rows with ``reject_reason`` and, for rejects, the message in ``raw_value``.

    A message is rejected when it cannot be read as declared, or when a text is
    longer than its target column.  Without this opt-in both are kept as rows, for which
    the target must take texts of any length.
    """
    decoded = envelope.transform(with_lineage).transform(decode_messages, keep_corrupt=True)
    unreadable = F.col("json").isNull() | F.col(f"json.{CORRUPT}").isNotNull()
    too_long = [
        F.when(F.char_length(f"json.{name}") > limit, F.lit(f"too long: {name}"))
        for name, limit in length_limits().items()
    ]
    reasons = F.concat_ws("; ", F.when(unreadable, F.lit("unreadable")), *too_long)
    flagged = decoded.withColumn("reject_reason", F.nullif(reasons, F.lit("")))
    flagged = flagged.withColumn(
        "raw_value", F.when(F.col("reject_reason").isNotNull(), F.col("value"))
    )
    return flatten_posts(flagged, keep=["reject_reason", "raw_value"])
