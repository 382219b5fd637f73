"""Epoch seconds to UTC timestamps, and back, without the session time zone.

``from_unixtime`` and casts between TIMESTAMP and TIMESTAMP_NTZ go through the
session zone, where an hour repeats or is missing twice a year.  Adding an
interval to a TIMESTAMP_NTZ does not, so the same input gives the same row
under any zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def _epoch_start() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def epoch_to_timestamp(seconds: Column) -> Column:
    """Whole seconds since 1970, fraction dropped toward zero, as UTC TIMESTAMP_NTZ.

    NULL, NaN, infinities and seconds beyond a timestamp's range give NULL, so
    one odd message cannot fail its batch on every retry.
    """
    since = F.try_multiply(F.expr("interval '1' second"), seconds.try_cast("bigint"))
    return _epoch_start() + since


def epoch_to_string(seconds: Column) -> Column:
    """The same moment as ``yyyy-MM-dd HH:mm:ss`` text in UTC."""
    return epoch_to_timestamp(seconds).cast("string")


def instant_to_utc(instant: Column) -> Column:
    """TIMESTAMP to the UTC wall clock as TIMESTAMP_NTZ, microseconds kept."""
    return _epoch_start() + F.expr("interval '0.000001' second") * F.unix_micros(instant)


def utc_to_micros(utc: Column) -> Column:
    """UTC TIMESTAMP_NTZ to microseconds since 1970."""
    since = (utc - _epoch_start()).cast("interval second").cast("decimal(18,6)")
    return (since * 1_000_000).cast("bigint")


def utc_to_instant(utc: Column) -> Column:
    """UTC TIMESTAMP_NTZ to TIMESTAMP."""
    return F.timestamp_micros(utc_to_micros(utc))


def utc_to_epoch(utc: Column) -> Column:
    """UTC TIMESTAMP_NTZ to seconds since 1970 with their fraction."""
    return utc_to_micros(utc) / F.lit(1_000_000.0)
