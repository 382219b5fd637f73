"""Where rows go before a write.  The job itself needs none of these.

Appending is a narrow stage, so the default is no shuffle at all.  Each
operator here returns a function for ``df.transform`` or a batch writer's
``spread``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Spread = Callable[[DataFrame], DataFrame]


def rebalance(*columns: str) -> Spread:
    """Even, well-sized write tasks, near rows with equal ``columns``.

    Adaptive execution merges small partitions and splits those that a hot key
    makes large, so this is the one to prefer when files must be sized.
    """
    return lambda df: df.hint("rebalance", *columns)


def salt(columns: Sequence[str], salts: int) -> Column:
    """A bucket in ``[0, salts)`` from a hash of what tells a row from others.

    It depends on the row alone, unlike ``rand()``, so a task that is run again
    after an executor is lost sends every row to the same place.  A hash, since
    a plain remainder may follow the same rhythm as the key.
    """
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salts_for(df: DataFrame, partitions: int | None = None) -> int:
    """So many salts that a third of all rows, cut into them, are average partitions."""
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return -(-partitions // 3)


def by_key(
    key: str,
    partitions: int | None = None,
    salts: int | None = None,
    salt_columns: Sequence[str] = ("kafka_partition", "kafka_offset"),
) -> Spread:
    """Rows of a key together, in at most ``salts`` partitions.

    A key that holds a third of all rows, NULL included, is split about evenly
    over its salts, so that no task gets it whole; by default there are as many
    as :func:`salts_for` says.  With ``salts=1`` each key is in one partition,
    however large that makes it.  Without ``partitions`` the session's setting
    applies and adaptive execution merges small ones; a given number is kept.
    Where the number of pieces need not be fixed, ``rebalance(key)`` splits
    only the keys that are large.
    """

    def spread(df: DataFrame) -> DataFrame:
        pieces = salts_for(df, partitions) if salts is None else salts
        columns = [F.col(key)] if pieces == 1 else [F.col(key), salt(salt_columns, pieces)]
        return df.repartition(*columns if partitions is None else (partitions, *columns))

    return spread


# Steps in which a row's place within the stretch of its key is told.
_STEPS = 1 << 20


def by_share(
    key: str,
    shares: Mapping[str | None, float],
    partitions: int,
    salt_columns: Sequence[str] = ("kafka_partition", "kafka_offset"),
) -> Spread:
    """Rows of a key in as many partitions as its share of all rows is worth.

    Partitions are a line on which every key of ``shares`` that is worth half of one or
    more has a stretch of its size; a hash of the row says where on it.  Other keys have the rest
    of the line, each whole at one place.  So partitions are even, but for what a share
    is off.  The stretches, two for each partition at most, are broadcast.
    """
    heavy = [(k, s) for k, s in shares.items() if s * partitions >= 0.5]
    heavy.sort(key=lambda x: (-x[1], x[0] is None, x[0] or ""))
    scale = partitions / max(1.0, sum(share for _, share in heavy))
    stretches, at = [], 0.0
    for value, share in heavy:
        stretches.append((value, at, share * scale))
        at += share * scale
    # Where measured keys fill the line, others are spread over all of it.
    rest = (at, partitions - at) if partitions - at >= 1 else (0.0, float(partitions))

    def spread(df: DataFrame) -> DataFrame:
        schema = "_key STRING, _first DOUBLE, _width DOUBLE"
        placed = F.broadcast(df.sparkSession.createDataFrame(stretches, schema))
        rows = df.join(placed, F.col(key).cast("string").eqNullSafe(F.col("_key")), "left")
        within = F.pmod(F.xxhash64(*salt_columns), F.lit(_STEPS)) / _STEPS
        light = F.pmod(F.xxhash64(key), F.lit(_STEPS)) / _STEPS
        place = F.when(F.col("_first").isNotNull(), F.col("_first") + within * F.col("_width"))
        place = F.floor(place.otherwise(rest[0] + light * rest[1])).cast("int")
        rows = rows.repartitionById(partitions, F.least(place, F.lit(partitions - 1)))
        return rows.select(*(df[name] for name in df.columns))

    return spread


class Measured:
    """A :data:`Spread` that places a batch by the key sizes of the batch before.

    A frequency sketch is taken by the write itself, over what every task writes, and merged:
    no pass of its own.  It tracks ``tracked`` keys and is off by some rows in that many.  The
    first batch after a start has no measure and is salted as :func:`by_key` does.
    """

    def __init__(
        self,
        key: str,
        partitions: int,
        salt_columns: Sequence[str] = ("kafka_partition", "kafka_offset"),
        tracked: int = 10_000,
    ) -> None:
        self._key, self._partitions, self._salt_columns = key, partitions, salt_columns
        self._tracked = max(tracked, 2 * partitions)
        self.shares: dict[str | None, float] = {}

    def measures(self) -> list[Column]:
        """Aggregates for the write to observe: sizes of all keys that could be heavy."""
        most = (F.lit(2 * self._partitions), F.lit(self._tracked))
        key = F.col(self._key).cast("string")
        return [F.call_function("approx_top_k", key, *most).alias("key_sizes")]

    def learn(self, observed: Mapping[str, object]) -> None:
        rows = observed["rows"]
        if rows:
            self.shares = {item["item"]: item["count"] / rows for item in observed["key_sizes"]}

    def __call__(self, df: DataFrame) -> DataFrame:
        if not self.shares:
            return by_key(self._key, self._partitions, salt_columns=self._salt_columns)(df)
        return by_share(self._key, self.shares, self._partitions, self._salt_columns)(df)
