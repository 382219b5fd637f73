"""op5: repeated chunks against a plain version."""

import re

import xxhash
from conftest import SMALL

from feedlift.llm.line_dedup import BASE, MEAN_LINES, PRIME, dedup_stage, drop_repeats

from .conftest import ROWS, prose, table


def _hash(text):
    number = xxhash.xxh64_intdigest(text.encode(), 42)
    return (number - (1 << 64) if number >> 63 else number) % PRIME


def chunks(text):
    lines = [x for x in re.split(r"(?<=\n)|(?<=[.!?,;:] )", text) if x]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        ends = i > 0 and (_hash(lines[i - 1]) * BASE + _hash(line)) % PRIME % MEAN_LINES == 0
        if ends or i == len(lines) - 1:
            out.append(now)
            now = []
    return out


def plain(rows):
    """Distinct (id, text) to the text that is left."""
    def order(row):
        number = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return (row[0] is not None, row[0] or 0, number - (1 << 64) if number >> 63 else number)

    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=order):
        if text is None:
            out[doc_id, text] = None
            continue
        left = ""
        for chunk in chunks(text):
            part = "".join(chunk)
            if len(chunk) > 1 and len(part.strip(" ")) >= 50:
                if part in seen:
                    continue
                seen.add(part)
            left += part
        out[doc_id, text] = left
    return out


def check(docs, rows):
    got = sorted(((r.doc_id, r.text) for r in drop_repeats(docs).collect()), key=repr)
    left = plain(rows)
    assert got == sorted(((row[0], left[row]) for row in rows), key=repr)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_documents(odd):
    check(odd, [r[:2] for r in ROWS])


def test_a_passage_is_found_wherever_it_stands(spark):
    """What stands before a passage does not move the ends of chunks inside it."""
    passage = "".join(f"{prose(100 + i, 9)}\n" for i in range(40))
    rows = [(i, prose(200 + i, 15 * i + 11) + "\n" + passage + prose(300 + i, 20)) for i in range(6)]
    left = {r.doc_id: r.text for r in drop_repeats(table(spark, rows)).collect()}
    assert left[0] == rows[0][1]
    for i in range(1, 6):
        assert len(left[i]) < len(rows[i][1]) - 0.7 * len(passage)
        assert left[i].startswith(rows[i][1][:100]) and left[i].endswith(prose(300 + i, 20)[-40:])


def test_short_phrases_stay(spark):
    rows = [(i, f"{prose(i, 30)} Well, yes, of course. {prose(50 + i, 30)}") for i in range(20)]
    assert all(r.text == rows[r.doc_id][1] for r in drop_repeats(table(spark, rows)).collect())


def test_stage_keeps_rows_and_columns(spark, odd):
    out = dedup_stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("n_chars != char_length(text)").isEmpty()


def test_no_documents(spark, nothing):
    assert drop_repeats(nothing).isEmpty()
