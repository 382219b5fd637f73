"""Passages of several lines that stand in more than one place, kept once.

A line is what ends with a newline; a paragraph written on one line is taken apart
behind its punctuation marks, and each part counts as one.  A rolling hash over the
hashes of neighbouring lines chooses where chunks end, by content alone: text put in
before a passage does not move the ends inside it.  Chunks of two or more lines that
occur again, in any document, are removed wherever they are not first, after their
bytes were compared.  All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.llm.common import packed, read_table, row_hash, unpacked, written

# A line ends behind a newline, or a mark and a blank.
LINE_ENDS = r"(?<=\n)|(?<=[.!?,;:] )"
# One place in so many is the end of a chunk.
MEAN_LINES = 3
# A chunk is removed only if it has at least so many lines and characters: what is
# shorter comes again in texts that have nothing to do with each other.
LEAST_LINES = 2
LEAST_CHARS = 50
BASE, PRIME = 1_000_003, 2_147_483_647


def _once(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns that later lambdas read instead of computing them for each element.

    The generator of one row keeps the optimizer from copying an expression into
    the lambda that refers to it.
    """
    for name, expression in columns.items():
        df = df.select("*", F.explode(F.array(F.expr(expression))).alias(name))
    return df


def with_chunks(df: DataFrame, lines_of: str) -> DataFrame:
    """Adds ``_chunks``: number, lines and text of each; joined, the texts are the whole text."""
    ended = f"""
        filter(sequence(0, size(_lines) - 1), i -> i = size(_lines) - 1 OR (i > 0 AND
            pmod(pmod(xxhash64(_lines[i - 1]), {PRIME}) * {BASE}
               + pmod(xxhash64(_lines[i]), {PRIME}), {PRIME}) % {MEAN_LINES} = 0))"""
    before = "if(k = 0, -1, _ends[k - 1])"
    chunks = f"""
        transform(_ends, (e, k) -> named_struct('k', k, 'n', e - {before},
            'text', array_join(slice(_lines, {before} + 2, e - {before}), '')))"""
    cut = _once(df, _lines=lines_of, _ends=f"if(size(_lines) = 0, array(), {ended})")
    return _once(cut, _chunks=chunks).drop("_lines", "_ends")


def _lines(text: str) -> str:
    return f"filter(split({text}, r'{LINE_ENDS}', -1), line -> line <> '')"


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and the numbers ``gone`` of chunks that stand earlier elsewhere.

    Earlier: in a row of a smaller id, or before in the same text.  Rows that
    share id and text are one document.
    """
    rows = docs.select("doc_id", row_hash().alias("text_key"), F.col("text").alias("_text"))
    cut = with_chunks(rows.where("_text <> ''"), _lines("_text"))
    chunks = cut.select("doc_id", "text_key", F.explode("_chunks").alias("c"))
    long = F.char_length(F.trim("c.text")) >= LEAST_CHARS
    chunks = chunks.where((F.col("c.n") >= LEAST_LINES) & long)
    part = F.col("c.text")
    chunks = chunks.select(
        "doc_id", "text_key", "c.k", F.xxhash64(part).alias("hash"), part.alias("part")
    )
    place = F.struct("doc_id", "text_key", "k")
    seen = chunks.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = written(
        chunks.join(seen.where("n > 1").drop("n"), "hash").withColumn(
            "is_first", F.struct("doc_id", "text_key", "k") == F.col("first")
        ),
        "op5-again",
    )
    first = again.where("is_first").select("hash", F.col("part").alias("first_part")).distinct()
    equal = again.where("NOT is_first").join(first, "hash").where("part = first_part")
    return equal.groupBy("doc_id", "text_key").agg(F.collect_set("k").alias("gone"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without repeated chunks, and ``_removed_chunks``, ``_removed_chars``.

    Rows and other columns stay as they are, if their names do not begin with ``_``; a row all of
    whose chunks are repeats stays with an empty text, a null text stays null,
    and single lines stay.  Repeated rows (same id and text) are one document
    and are cut alike.  A missing id sorts before all others.
    """
    gone = repeated_chunks(docs).withColumnsRenamed(
        {"doc_id": "_op5_id", "text_key": "_op5_key", "gone": "_op5_gone"}
    )
    keyed = docs.withColumn("_op5_text_key", row_hash())
    met = keyed["doc_id"].eqNullSafe(gone["_op5_id"]) & (
        keyed["_op5_text_key"] == gone["_op5_key"]
    )
    marked = keyed.join(gone, met, "left").drop("_op5_id", "_op5_key", "_op5_text_key")
    # Texts without a repeat are not cut again.
    cut = with_chunks(marked, f"if(_op5_gone IS NULL, array(), {_lines('text')})")
    kept = "array_except(sequence(0, size(_chunks) - 1), _op5_gone)"
    lost = "aggregate(_op5_gone, 0L, (n, k) -> n + char_length(_chunks[k].text))"
    cut = _once(cut, _kept=f"if(_op5_gone IS NULL, array(), {kept})")
    rest = "array_join(transform(_kept, k -> _chunks[k].text), '')"
    columns = {
        "text": F.expr(f"if(_op5_gone IS NULL, text, {rest})"),
        "_removed_chunks": F.expr("if(_op5_gone IS NULL, 0, size(_op5_gone))").cast("long"),
        "_removed_chars": F.expr(f"if(_op5_gone IS NULL, 0L, {lost})"),
    }
    return cut.withColumns(columns).drop("_op5_gone", "_chunks", "_kept")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with shortened texts; ``n_chars`` follows the text where there is such a column.

    Columns may have any name; all but those two are as they were.
    """
    out = drop_repeats(packed(docs, "doc_id", "text"))
    out = unpacked(out, docs.columns, "doc_id", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was removed from each document, and a digest of what is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select(
        "doc_id",
        F.col("_removed_chunks").alias("removed_chunks"),
        F.col("_removed_chars").alias("removed_chars"),
        F.char_length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
