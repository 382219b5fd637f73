"""License notices found by voting on diagonals.

All pairs of neighbouring words of a document are joined by hash with those of
the templates.  A hit at word p of the document and word t of a template votes for
the diagonal p - t, where the template would begin.  A phrase stands where
one diagonal has all its pairs; a notice may have lost or gained words, so
neighbouring diagonals are merged, and what they cover is held against the
notice's length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedlift.llm.common import read_table, row_hash, text_or_empty

# The phrases that are always looked for, word for word.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
# Wordings by which works are put under a license.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international "
    "license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and/or modify it under "
    "the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and/or distribute this software for any purpose with or "
    "without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of "
    "this software and associated documentation files the software to deal in the software "
    "without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
}
# Pairs a diagonal of a notice needs to be merged with its neighbours, how far apart
# neighbours may be, and which share of a notice's pairs must be found.
LEAST_VOTES = 2
MOST_SHIFT = 4
LEAST_COVERED = 0.75

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words(text: str) -> list[str]:
    return [word for word in re.split(_NOT_WORD, text.lower()) if word]


def _template_pairs(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """Label, whether word for word, number of pairs, place, and the two words."""
    rows = []
    for exact, given in ((True, phrases), (False, notices)):
        for label, text in given.items():
            words = _template_words(text)
            if len(words) < 2:
                raise ValueError(f"template {label!r} has fewer than two words")
            for place, (one, two) in enumerate(zip(words, words[1:], strict=False)):
                rows.append((label, exact, len(words) - 1, place, one, two))
    return rows


def templates(
    spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES
) -> DataFrame:
    """One row for each pair of neighbouring words of each template.

    As large as the dictionaries handed over, whatever the corpus.
    """
    schema = "label string, exact boolean, pairs int, t int, t_one string, t_two string"
    table = spark.createDataFrame(_template_pairs(phrases, notices), schema)
    return table.withColumn("t_hash", F.xxhash64("t_one", "t_two"))


def word_pairs(docs: DataFrame) -> DataFrame:
    """A row for each word with the word after it, NULL after the last; one if there is no word."""
    # Only ASCII characters part words, and lower() turns no other character into one that does.
    words = F.array_remove(F.split(F.lower(text_or_empty()), _NOT_WORD), "")
    rows = docs.select("doc_id", row_hash().alias("text_key"), F.explode(F.array(words)).alias("w"))
    after = F.expr("concat(slice(w, 2, size(w)), array(CAST(NULL AS STRING)))")
    pairs = rows.withColumn("n_words", F.size("w").cast("long")).select(
        "doc_id",
        "text_key",
        "n_words",
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("one"), after.alias("two"))),
    )
    return pairs.select(
        "doc_id",
        "text_key",
        "n_words",
        F.col("pos").cast("long").alias("p"),
        F.col("col.one").alias("one"),
        F.col("col.two").alias("two"),
    )


def hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Votes: a row for each pair of words that a template has, and one more for each document."""
    pairs = word_pairs(docs).withColumn("hash", F.xxhash64("one", "two"))
    # The templates are a few hundred rows, given by hand.
    met = (
        (F.col("hash") == F.col("t_hash"))
        & (F.col("one") == F.col("t_one"))
        & (F.col("two") == F.col("t_two"))
    )
    voted = pairs.join(F.broadcast(table), met, "left")
    kept = voted.where(F.col("label").isNotNull() | F.col("two").isNull() | (F.col("n_words") == 0))
    return kept.select(
        "doc_id", "text_key", "n_words", "label", "exact", "pairs", "p", "t",
        (F.col("p") - F.col("t")).alias("diagonal"),
    )


def spans(votes: DataFrame) -> DataFrame:
    """Where templates stand: ``first`` and ``last`` word, ``covered`` share of the pairs.

    Rows that only count a document stay, with a null label and their number
    in ``copies``.
    """
    row = ["doc_id", "text_key", "n_words", "label", "exact", "pairs"]
    # All later groups are within a document: its votes are brought together once.
    placed = votes.repartition("doc_id", "text_key")
    lines = placed.groupBy(*row, "diagonal").agg(
        F.min("p").alias("p_first"),
        F.max("p").alias("p_last"),
        F.collect_set("t").alias("ts"),
        F.count_if(F.col("label").isNull()).alias("copies"),
    )
    strong = F.col("exact") | (F.size("ts") >= F.least(F.lit(LEAST_VOTES), F.col("pairs")))
    lines = lines.where(F.col("label").isNull() | strong)
    along = Window.partitionBy("doc_id", "text_key", "n_words", "label").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.coalesce(F.col("exact") | (step > MOST_SHIFT), F.lit(True)).cast("int")
    lines = lines.withColumn("apart", apart)
    lines = lines.withColumn("place", F.sum("apart").over(along))
    places = lines.groupBy(*row, "place").agg(
        F.min("p_first").alias("first"),
        (F.max("p_last") + 1).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("found"),
        F.sum("copies").alias("copies"),
    )
    places = places.withColumn("covered", F.col("found") / F.col("pairs"))
    whole = F.when(F.col("exact"), F.col("found") == F.col("pairs")).otherwise(
        (F.col("covered") >= LEAST_COVERED)
        & (F.col("last") - F.col("first") <= 2 * F.col("pairs") + MOST_SHIFT)
    )
    return places.where(F.col("label").isNull() | whole)


def scan(docs: DataFrame, table: DataFrame) -> DataFrame:
    """License findings of every row of ``docs`` by id and text.

    Spans are words counted from 0, the last one included.  A null or empty text
    has no words and no findings.  Rows that share id and text are scanned
    together and get equal rows; a missing id is an id of its own.  Other
    columns of ``docs`` are not looked at.
    """
    found = spans(hits(docs, table))

    def over(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    exact = F.col("exact") & F.col("label").isNotNull()
    labelled = F.col("label").isNotNull()
    span = F.struct("first", "last", "label", "covered")
    rows = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(exact).alias("n_base"),
        F.min(over(exact, F.col("first"))).alias("first_word"),
        F.max(over(exact, F.col("first"))).alias("last_word"),
        F.sort_array(F.collect_set(over(exact, F.col("label")))).alias("base"),
        F.sort_array(F.collect_set(F.col("label"))).alias("all"),
        F.sort_array(F.collect_list(over(labelled, span))).alias("spans"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        F.sum("copies").alias("copies"),
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return rows.select("*", again).drop("copies", "copy")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), templates(spark))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("all", ",").alias("labels"),
        "score",
    )


_VALUES = ", ".join(
    f"('{label}', {exact}, {pairs}, {t}, '{one}', '{two}')"
    for label, exact, pairs, t, one, two in _template_pairs(PHRASES, NOTICES)
)
ORACLE = f"""
WITH templates(label, exact, pairs, t, one, two) AS (VALUES {_VALUES}),
docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_NOT_WORD}'),
                       lambda x: x <> '') AS w
    FROM documents),
pairs AS (
    SELECT r, p, w[p + 1] AS a, w[p + 2] AS b
    FROM (SELECT r, w, unnest(range(len(w) - 1)) AS p FROM docs WHERE len(w) > 1)),
lines AS (
    SELECT r, label, exact, pairs, p - t AS diagonal, min(p) AS p_first, max(p) AS p_last,
           list(DISTINCT t) AS ts
    FROM pairs JOIN templates ON a = one AND b = two
    GROUP BY ALL HAVING exact OR count(DISTINCT t) >= least({LEAST_VOTES}, pairs)),
stepped AS (
    SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER o <= {MOST_SHIFT} IS NOT TRUE
                   THEN 1 ELSE 0 END AS apart
    FROM lines WINDOW o AS (PARTITION BY r, label ORDER BY diagonal)),
placed AS (
    SELECT *, sum(apart) OVER (PARTITION BY r, label ORDER BY diagonal) AS place FROM stepped),
places AS (
    SELECT r, label, exact, pairs, place, min(p_first) AS "first", max(p_last) + 1 AS "last",
           len(list_distinct(flatten(list(ts)))) AS found
    FROM placed GROUP BY ALL),
spans AS (
    SELECT * FROM places
    WHERE CASE WHEN exact THEN found = pairs
               ELSE found / pairs >= {LEAST_COVERED}
                    AND "last" - "first" <= 2 * pairs + {MOST_SHIFT} END),
by_doc AS (
    SELECT r, count(*) FILTER (exact) AS n_base, min("first") FILTER (exact) AS first_word,
           max("first") FILTER (exact) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(found / pairs) AS score
    FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN by_doc USING (r)
"""
