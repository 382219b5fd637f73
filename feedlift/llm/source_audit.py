"""How far the words of sources lie apart, for each language.

Texts are bytes: one translate table lowers the letters and blanks every separator, a
split cuts the terms and a ``Counter`` per document counts them.  Tasks add up the counts
of what they read, so that a term comes to the shuffle once for each task and group, however
many documents hold it.

A group, a source of a language, gives each term a smoothed share in billionths.  Two
groups differ by a sum over all kept terms, of which most stand in neither: with ``p0`` for
the share of an absent term,

    sum over all terms of f(p, q) =
        sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
      + sum over terms of the one of f(p, q0) + sum over terms of the other of f(p0, q)
      + (terms - terms of the one - terms of the other) * f(p0, q0)

so that only counts that are there are ever looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedlift.llm.common import read_table, written

# Terms are kept that stand in so many documents of the language.
LEAST_DOCUMENTS = 10
# Terms that are listed of each group.
TOP_TERMS = 10
# Shares are in so many parts; whole numbers, so that every sum is exact.
PARTS = 1_000_000_000
# Counts that a task holds before it hands them on.
MOST_COUNTS = 600_000
# Pairs of counts that a task looks at in one step.
MOST_PAIRS = 500_000

_SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_TABLE = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())

_COUNTED = pa.schema(
    [
        ("lang", pa.string()),
        ("source", pa.string()),
        ("term", pa.binary()),
        ("n", pa.int64()),
        ("docs", pa.int64()),
    ]
)


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of anything that is not ASCII, A to Z lowered."""
    return text.translate(_TABLE).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of terms by group.  A group as such is a row without a term."""
    # Of each group and term: how many documents hold it, and how often they repeat it.
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_on() -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _COUNTED]
        for (lang, source), (documents, repeats) in groups.items():
            counts = [n + repeats.get(term, 0) for term, n in documents.items()]
            rows = len(counts) + 1
            parts = ([lang] * rows, [source] * rows, [None, *documents], [0, *counts])
            for column, values in zip(columns, (*parts, [0, *documents.values()]), strict=True):
                column += values
        groups.clear()
        arrays = [pa.array(c, field.type) for c, field in zip(columns, _COUNTED, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=_COUNTED)

    for batch in batches:
        texts, langs, sources = (batch.column(name) for name in ("text", "lang", "source"))
        for number in range(batch.num_rows):
            key = langs[number].as_py(), sources[number].as_py()
            if key not in groups:
                groups[key] = Counter(), Counter()
            documents, repeats = groups[key]
            before = len(documents)
            found = Counter(terms(texts[number].as_py()))
            documents.update(found.keys())
            for term, n in found.items():
                if n > 1:
                    repeats[term] += n - 1
            held += len(documents) - before
            if held >= MOST_COUNTS:
                yield handed_on()
                held = 0
    yield handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, its occurrences ``n`` and the ``docs`` that hold it.

    Null texts, languages and sources are empty ones.  Every group that occurs has a
    row without a term besides.  Repeated rows count as often as they are there, and other
    columns are not looked at.
    """
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col("text").cast("string"), empty).cast("binary").alias("text"),
        *(F.coalesce(F.col(name).cast("string"), empty).alias(name) for name in ("lang", "source")),
    )
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counted = counted.withColumn("term", F.col("term").cast("string"))
    return counted.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(PARTS * (count + 2) / (total + 2 * kept))`` without leaving 64 bits.

    Long division by a thousand at a time: exact up to a total of 9e15 terms.
    """
    of = F.nullif(total + 2 * kept, F.lit(0))

    def divided(value: Column) -> tuple[Column, Column]:
        return F.call_function("div", value, of), value % of

    whole, rest = divided(count + 2)
    for _ in range(3):
        digits, rest = divided(rest * 1000)
        whole = whole * 1000 + digits
    return 1 + whole


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart_numbers(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_PAIRED = pa.schema(
    [("lang", pa.string()), ("one", pa.string()), ("other", pa.string()), ("value", pa.int64())]
)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For groups that share terms, what these terms add, summed over some of them at a time.

    A row is a term with its shares by source.  Each share meets those of the same term.
    """
    for batch in batches:
        lists = batch.column("shares")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        sources = flat.field("source").dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), sizes).astype(np.int64)
        source = sources.indices.to_numpy().astype(np.int64)
        p, p0 = (flat.field(name).to_numpy().astype(np.int64) for name in ("p", "p0"))
        begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
        meets = np.repeat(sizes, sizes)
        reached = np.cumsum(meets)
        start = 0
        while start < len(p):
            past = reached[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(reached, past + MOST_PAIRS, "right")))
            here = meets[start:end]
            one = np.repeat(np.arange(start, end), here)
            within = np.arange(len(one)) - np.repeat(np.cumsum(here) - here, here)
            other = begins[one] + within
            one, other = one[one != other], other[one != other]
            value = _apart_numbers(p[one], p[other]) + _apart_numbers(p0[one], p0[other])
            value -= _apart_numbers(p[one], p0[other]) + _apart_numbers(p0[one], p[other])
            count = len(sources.dictionary)
            key = (lang[one] * count + source[one]) * count + source[other]
            order = np.argsort(key, kind="stable")
            keys, firsts = np.unique(key[order], return_index=True)
            sums = np.add.reduceat(value[order], firsts) if len(firsts) else value[:0]
            columns = [
                langs.dictionary.take(pa.array(keys // (count * count))),
                sources.dictionary.take(pa.array(keys // count % count)),
                sources.dictionary.take(pa.array(keys % count)),
                pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_PAIRED)
            start = end


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: how far each other source of the language is from the source, all of
    them.  Part ``term``: kept terms that the source has a larger share of than the language,
    the ``top`` first.  Ranks go by value, then by item as UTF-8.  A group without terms has
    its pairs; an empty table gives no rows.  What each column's nulls mean is told at
    :func:`term_counts`.

    Counts are written to the shared folder and read several times.  Joins are by language
    and term or by group; a term has a row for each source at most.
    """
    counts = written(term_counts(docs), "term-counts")
    in_lang = counts.where(F.col("term").isNotNull()).groupBy("lang", "term")
    in_lang = in_lang.agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
    kept_terms = in_lang.where(F.col("lang_docs") >= least).drop("lang_docs")
    kept = written(counts.join(kept_terms, ["lang", "term"]).drop("docs"), "kept-terms")

    sizes = kept.groupBy("lang", "source")
    sizes = sizes.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = kept_terms.groupBy("lang")
    langs = langs.agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    zero = F.lit(0).cast("long")
    groups = (
        counts.where(F.col("term").isNull())
        .select("lang", "source")
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "own", "kept", "lang_total"])
        .withColumn("p0", share(zero, F.col("total"), F.col("kept")))
    )
    groups = written(groups, "groups")

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", "lang_n", "lang_total", "kept",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
    )

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    salient = shares.withColumn("q", q).where(F.col("p") > F.col("q"))
    salient = salient.select(
        "lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")
    )

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        rank = F.row_number().over(order).alias("rank")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)

    one = groups.select("lang", "source", "own", "kept", "p0")
    other = groups.select(
        "lang", F.col("source").alias("item"), F.col("own").alias("q_own"), F.col("p0").alias("q0")
    )
    pairs = one.join(other, "lang").where(F.col("source") != F.col("item"))
    absent = F.col("kept") - F.col("own") - F.col("q_own")
    absent = F.coalesce(absent * _apart(F.col("p0"), F.col("q0")), zero)

    # Terms of a group that have the same share differ alike from what is absent.
    alike = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("alike"))
    against_absent = alike.join(pairs.select("lang", "source", "item", "q0"), ["lang", "source"])
    against_absent = against_absent.groupBy("lang", "source", "item").agg(
        F.sum(F.col("alike") * _apart(F.col("p"), F.col("q0"))).alias("value")
    )
    by_term = shares.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "p", "p0")).alias("shares")
    )
    met = by_term.select("lang", "shares").mapInArrow(
        _meet, "lang string, one string, other string, value long"
    )
    value = (
        pairs.select("lang", "source", "item", absent.alias("value"))
        .unionByName(against_absent)
        .unionByName(
            against_absent.select(
                "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"
            )
        )
        .unionByName(met.withColumnsRenamed({"one": "source", "other": "item"}))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    firsts = ranked(salient, "term").where(F.col("rank") <= top)
    return ranked(value, "pair").unionByName(firsts)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


# The same without the sparse form: every kept term of every pair of groups.
ORACLE = """
WITH words AS (
    SELECT rowid AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
),
kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term
    HAVING count(DISTINCT row_no) >= 10
),
counts AS (
    SELECT lang, source, term, count(*) AS n
    FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
),
groups AS (
    SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
),
sizes AS (
    SELECT lang, source,
           (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v,
           (SELECT coalesce(sum(n), 0) FROM counts c
            WHERE c.lang = g.lang AND c.source = g.source)::HUGEINT AS total,
           (SELECT coalesce(sum(n), 0) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS lang_total
    FROM groups g
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.v) AS q
    FROM sizes g JOIN kept k ON k.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item,
           sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b
    ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           CAST(coalesce(p.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)
    FROM shares WHERE n > 0 AND p > q
),
ranked AS (
    SELECT *, CAST(row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
