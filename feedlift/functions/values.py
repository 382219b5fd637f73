"""Defaults and conversions that turn a raw post into a wire record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedlift.schema import NO_AUTHOR, NO_TEXT


def or_empty(text: Column) -> Column:
    """Missing text becomes the empty string."""
    return F.coalesce(text.cast("string"), F.lit(NO_TEXT))


def or_unknown(author: Column) -> Column:
    """A post whose author is gone is credited to a fixed name."""
    return F.coalesce(author.cast("string"), F.lit(NO_AUTHOR))


def to_whole(number: Column) -> Column:
    """A number as BIGINT, truncated toward zero; NULL where it has no such value."""
    return number.try_cast("bigint")


def to_real(number: Column) -> Column:
    return number.try_cast("double")


def lacks_whole(number: Column) -> Column:
    """True where there is no whole number to send: NULL, NaN, infinite or beyond BIGINT."""
    return to_whole(number).isNull()
