"""The three row shapes of the job: wire record, topic envelope, target table."""

from __future__ import annotations

# The keys and types of a message, in wire order.
WIRE_TYPES = {
    "id": "STRING",
    "title": "STRING",
    "author": "STRING",
    "subreddit": "STRING",
    "score": "INT",
    "upvote_ratio": "DOUBLE",
    "num_comments": "INT",
    "created_utc": "DOUBLE",
    "url": "STRING",
    "selftext": "STRING",
}

# A raw post before normalisation; its counts may come as any number.
RAW_TYPES = WIRE_TYPES | {"score": "DOUBLE", "num_comments": "DOUBLE"}

# Spark's public schema of a Kafka topic.
ENVELOPE_TYPES = {
    "key": "BINARY",
    "value": "BINARY",
    "topic": "STRING",
    "partition": "INT",
    "offset": "BIGINT",
    "timestamp": "TIMESTAMP",
    "timestampType": "INT",
}

# The columns of the target table; its timestamps are in UTC.
TARGET_TYPES = {
    "id": "VARCHAR(128)",
    "title": "VARCHAR(1024)",
    "author": "VARCHAR(256)",
    "subreddit": "VARCHAR(256)",
    "score": "INT",
    "upvote_ratio": "DOUBLE",
    "num_comments": "INT",
    "created_utc": "TIMESTAMP_NTZ",
    "url": "VARCHAR(2048)",
    "selftext": "STRING",
    "kafka_timestamp": "TIMESTAMP_NTZ",
    "kafka_partition": "INT",
    "kafka_offset": "BIGINT",
}

# What stands in for a missing text or a missing author.
NO_TEXT = ""
NO_AUTHOR = "unknown"

WIRE_COLUMNS = list(WIRE_TYPES)
TARGET_COLUMNS = list(TARGET_TYPES)
LINEAGE_COLUMNS = [c for c in TARGET_COLUMNS if c.startswith("kafka_")]

def ddl(types: dict[str, str]) -> str:
    """Columns and their types as Spark reads them from a string."""
    return ", ".join(f"{name} {kind}" for name, kind in types.items())


def length_limits() -> dict[str, int]:
    """Longest text, in characters, that each bounded target column accepts."""
    return {
        name: int(kind[len("VARCHAR("):-1])
        for name, kind in TARGET_TYPES.items()
        if kind.startswith("VARCHAR(")
    }


def target_read_types() -> dict[str, str]:
    """The target's column types for reading files: lengths bind writers only."""
    limits = length_limits()
    return {name: "STRING" if name in limits else kind for name, kind in TARGET_TYPES.items()}
