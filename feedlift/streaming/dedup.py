"""Messages that a topic holds several times, taken once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PLACE_KEY = ("topic", "partition", "offset")
# How long after its first arrival a message may come again.
KEPT_FOR = "2 hours"
_SEEN = "_seen_at"


def take_once(
    envelope: DataFrame, kept_for: str = KEPT_FOR, key: Sequence[str] = PLACE_KEY
) -> DataFrame:
    """A stream without the messages whose ``key`` has come before, whichever batch it was in.

    The state is a key for each message of the last ``kept_for`` or a little longer.  Its
    clock is that of the batches, not the messages' own times: no message is ever
    late, so none is lost where partitions or files are far apart in time.  What comes
    again later than that counts as new.

    The keys are shuffled once, evenly, since offsets differ; on a cluster keep the state in
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).  Topics with a log need
    this only for messages that were published twice under one place.
    """
    seen = envelope.withColumn(_SEEN, F.current_timestamp()).withWatermark(_SEEN, kept_for)
    return seen.dropDuplicatesWithinWatermark(list(key)).drop(_SEEN)
