"""Raw posts to wire records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from feedlift.functions.values import lacks_whole, or_empty, or_unknown, to_real, to_whole
from feedlift.schema import WIRE_COLUMNS

REQUIRED_WHOLE = ("score", "num_comments")
REQUIRED_REAL = ("upvote_ratio", "created_utc")


def normalize_posts(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ten wire columns, with defaults and types applied, plus those in ``keep``."""
    rules = {
        "title": or_empty,
        "author": or_unknown,
        "url": or_empty,
        "selftext": or_empty,
        **dict.fromkeys(REQUIRED_WHOLE, to_whole),
        **dict.fromkeys(REQUIRED_REAL, to_real),
    }
    wire = [
        (rules[name](F.col(name)) if name in rules else F.col(name).cast("string")).alias(name)
        for name in WIRE_COLUMNS
    ]
    return raw.select(*wire, *keep)


def flag_unusable(raw: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the required numbers a post lacks, or NULL.

    Such a post has no wire record.  The flag lets a job set it aside and go
    on; filter on it before :func:`normalize_posts`.
    """
    gaps = [F.when(lacks_whole(F.col(c)), F.lit(c)) for c in REQUIRED_WHOLE]
    gaps += [F.when(to_real(F.col(c)).isNull(), F.lit(c)) for c in REQUIRED_REAL]
    return raw.withColumn("reject_reason", F.nullif(F.concat_ws(",", *gaps), F.lit("")))
