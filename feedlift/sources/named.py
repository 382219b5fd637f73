"""Streams of names: what a batch reads is decided when it runs.

A stream over files can only list a folder and read all of it as one type.  Where files must be
named by a log, or be read by the types they have, the stream carries their names, and
each batch opens what its names say.  It is described like a DataFrame, by steps, and
started like one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

BatchFunction = Callable[[DataFrame, int], None]
Step = Callable[[DataFrame], DataFrame]


class NamedStream:
    """Rows that ``read`` makes of a batch of ``names``, and the steps they go through."""

    def __init__(self, names: DataFrame, read: Step, steps: tuple[Step, ...] = ()) -> None:
        self.names, self._read, self._steps = names, read, steps

    @property
    def sparkSession(self) -> SparkSession:
        return self.names.sparkSession

    def transform(self, step: Callable[..., DataFrame], *args: object, **kwargs: object):
        """One step more for the rows of every batch."""
        taken = partial(_call, step, args, kwargs)
        return NamedStream(self.names, self._read, (*self._steps, taken))

    def where(self, condition: object):
        return self.transform(lambda rows: rows.where(condition))

    def over(self, write_batch: BatchFunction) -> BatchFunction:
        """``write_batch`` of rows as a function of a batch of names."""

        def write(names: DataFrame, number: int) -> None:
            rows = self._read(names)
            for step in self._steps:
                rows = step(rows)
            write_batch(rows, number)

        return write


def _call(step: Callable[..., DataFrame], args: tuple, kwargs: dict, rows: DataFrame) -> DataFrame:
    return step(rows, *args, **kwargs)


Stream = DataFrame | NamedStream
