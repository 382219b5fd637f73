"""Wire records to message bytes and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from feedlift.schema import WIRE_COLUMNS, WIRE_TYPES, ddl

CORRUPT = "_corrupt_record"


def encode_record(columns: Iterable[str] = WIRE_COLUMNS, ascii_only: bool = False) -> Column:
    """One flat JSON object per row as UTF-8 bytes, missing values as explicit nulls.

    ``ascii_only`` escapes every other character.  It decodes to the same
    record; plain UTF-8 is the default because it is smaller for most scripts.
    """
    options = {"ignoreNullFields": "false"}
    if ascii_only:
        options["writeNonAsciiCharacterAsCodePoint"] = "true"
    return F.to_json(F.struct(*columns), options).cast("binary")


def message_text(value: Column) -> Column:
    """Message bytes as text; bytes that are not UTF-8 are kept as they are."""
    return value.cast("string")


def decode_record(value: Column, keep_corrupt: bool = False) -> Column:
    """Message bytes to a struct of the wire fields, permissively.

    Unreadable text gives a struct of NULLs, a field of the wrong type nulls
    only itself, and an empty or NULL value gives a NULL struct.  With
    ``keep_corrupt`` the text of a message that lost anything is kept beside.

    ``from_json`` is not compiled, and neither is what Catalyst folds into it.
    Asking for ``value`` twice keeps the step that made it out, and compiled.
    """
    schema, options = ddl(WIRE_TYPES), {}
    if keep_corrupt:
        schema = ddl(WIRE_TYPES | {CORRUPT: "STRING"})
        options = {"columnNameOfCorruptRecord": CORRUPT}
    return F.when(value.isNotNull(), F.from_json(message_text(value), schema, options))
