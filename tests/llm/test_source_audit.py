"""Divergence of sources against SQL and against a plain version that is dense."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from check import connect, differences
from feedlift.llm import source_audit
from feedlift.llm.source_audit import ORACLE, audit, op11_source_divergence, share, terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain(rows, least=10, top=10):
    """Every kept term for every pair of groups."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(lowered(text))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [term for term, n in docs[lang].items() if n >= least]

        def shares(of):
            total = sum(of[term] for term in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = sum((counts[lang, source] for source in sources), Counter())
        base = shares(whole)
        for source in sources:
            p = shares(counts[lang, source])

            def apart(q, over):
                return sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in over)

            pairs = [(apart(shares(counts[lang, o]), kept), o) for o in sources if o != source]
            own = [t for t in kept if counts[lang, source][t] and p[t] > base[t]]
            single = [(apart(base, [t]), t) for t in own]
            for part, found, most in (("pair", pairs, None), ("term", single, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found[:most], 1):
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def got(df):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(map(tuple, rows))


def test_terms():
    text = "Ab-cD éÉ 日本\U0001f600x\n\x00\x7f[z]`{}~9"
    assert [t.decode() for t in terms(text.encode())] == TERM.findall(lowered(text))
    every = "".join(map(chr, range(0x250)))
    assert [t.decode() for t in terms(every.encode())] == TERM.findall(lowered(every))
    assert terms(b"") == []


def test_query_equals_sql(spark):
    found = op11_source_divergence(spark, SMALL).toArrow()
    assert found.num_rows > 0
    assert differences(connect(SMALL), found, ORACLE) == ""


@pytest.mark.parametrize("least", [1, 2, 3, 50])
def test_odd_documents(spark, odd, least):
    rows = [tuple(row) for row in odd.select("text", "lang", "source").collect()]
    assert got(audit(odd, least=least)) == plain(rows, least)


def test_ties_and_one_large_group(spark):
    rows = [("x y Z é", "en", "hot")] * 60 + [("x q", "en", "b"), ("q q ü", "en", None)] * 12
    rows += [("", "fr", "s"), (None, "fr", "t"), ("lone", None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(audit(docs)) == plain(rows)


def test_top_is_a_parameter(spark, odd):
    rows = [tuple(row) for row in odd.select("text", "lang", "source").collect()]
    assert got(audit(odd, least=1, top=3)) == plain(rows, 1, 3)


def test_empty_table(spark, nothing):
    assert audit(nothing).count() == 0


def test_share_is_exact_beyond_64_bits(spark):
    cases = [(0, 0, 1), (5, 9, 2), (10**12, 10**13, 10**6), (8 * 10**15, 9 * 10**15, 10**8)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    values = df.select(share(F.col("n"), F.col("total"), F.col("kept"))).collect()
    assert [v[0] for v in values] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    nothing = spark.createDataFrame([(0, 0, 0)], "n long, total long, kept long")
    assert nothing.select(share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] is None


def test_counts_handed_on_early_add_up(monkeypatch):
    texts = [b"a b c", b"c d a a", b"", b"x a"] * 5
    batch = pa.RecordBatch.from_pydict(
        {"text": texts, "lang": ["l"] * 20, "source": ["s", "t"] * 10}
    )

    def summed():
        total = Counter()
        for out in source_audit._count(iter([batch])):
            for row in out.to_pylist():
                key = row["lang"], row["source"], row["term"]
                total[key, "n"] += row["n"]
                total[key, "docs"] += row["docs"]
        return total

    whole = summed()
    monkeypatch.setattr(source_audit, "MOST_COUNTS", 2)
    assert summed() == whole
    assert whole[("l", "t", b"a"), "n"] == 15


def test_pairs_taken_in_steps_add_up(monkeypatch):
    def posting(source, p):
        return {"source": source, "p": p, "p0": 7}

    rows = [[posting(s, 100 * n + 13 * i) for i, s in enumerate("abcde")] for n in range(1, 4)]
    kind = pa.list_(pa.struct({"source": pa.string(), "p": pa.int64(), "p0": pa.int64()}))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["l", "l", "m"]), pa.array([*rows[:2], []], kind)], ["lang", "shares"]
    )

    def summed():
        total = Counter()
        for out in source_audit._meet(iter([batch])):
            for row in out.to_pylist():
                total[row["lang"], row["one"], row["other"]] += row["value"]
        return total

    whole = summed()
    monkeypatch.setattr(source_audit, "MOST_PAIRS", 3)
    assert summed() == whole
    assert len(whole) == 20
