"""Stages leave columns of any name as they are, those that the modules use themselves too."""

import inspect
import re

import corpus_pipeline
import pytest
from conftest import SMALL

from feedlift.llm import common, components, decontaminate, line_dedup, quality, simhash

from .conftest import FIELDS, ROWS

MODULES = {
    "quality": quality,
    "line_dedup": line_dedup,
    "simhash": simhash,
    "decontaminate": decontaminate,
}


def names_in(*modules):
    """What is quoted, aliased or begins with an underscore in the modules' code."""
    code = "".join(map(inspect.getsource, modules))
    found = {name.lower() for name in re.findall(r"""["'.`]([A-Za-z_]\w*)["'`]|\b(_\w+)\b""", code)
             for name in name if name}
    own = {field.split()[0] for field in FIELDS.split(", ")}
    return sorted(name for name in found - own if not name.startswith("__"))


@pytest.mark.parametrize("name", MODULES)
def test_columns_of_any_name(spark, name):
    names = names_in(MODULES[name], common, components)
    assert len(names) > 20
    docs = spark.createDataFrame(ROWS, FIELDS)
    docs = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in names),
                           "doc_id AS `a.b c`")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SMALL)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows
    for row in rows:
        told = "" if row.doc_id is None else str(row.doc_id)
        want = [None if row.doc_id is None else n + told for n in names]
        assert [row[n] for n in names] == want and row["a.b c"] == row.doc_id
