"""The registered queries without the text operators and what is built on them."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LEFT_OUT = [
    ("feedlift/llm",),
    ("corpus_pipeline.py",),
    ("feedlift/llm", "corpus_pipeline.py"),
]


@pytest.mark.parametrize("left_out", LEFT_OUT, ids="+".join)
def test_entry_imports_without(left_out, tmp_path):
    skipped = shutil.ignore_patterns(".git", "tests", "__pycache__")
    tree = tmp_path / "tree"
    shutil.copytree(HERE, tree, ignore=lambda folder, names: {
        name for name in names
        if os.path.relpath(os.path.join(folder, name), HERE) in left_out
    } | skipped(folder, names))
    code = (
        "import __spark_entry__ as e; names = set(e.queries());"
        "assert names >= set(e.oracle_sql());"
        "print(len(names), 'pipeline' in names, any(n.startswith('op1_') for n in names))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, pipeline, texts = done.stdout.split()
    assert int(count) >= 38
    assert pipeline == "False"
    assert texts == str("feedlift/llm" not in left_out)
