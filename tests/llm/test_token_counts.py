"""op10: trees after edits are those of the edited texts."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedlift.llm.encoding import tokenizer_path
from feedlift.llm.token_counts import BLOCK, Tree, apply_edits, build_trees, counter, op10_token_counts

from .conftest import ROWS, prose

TOKENIZER = Tokenizer.from_file(tokenizer_path())
TOKENIZER.encode_special_tokens = True
COUNT = counter(tokenizer_path())
PARTS = ["a", "b", " ", "  ", "\n", "'re", "'", "1", "23", ".", "!!", "é", "word", "\t", " the"]
PARTS += ["don't", "   ", "'l", "l", "<|endoftext|>", "日"]


def change(start, removed, inserted):
    return F.struct(
        F.lit(start).cast("long").alias("start"),
        F.lit(removed).cast("long").alias("removed"),
        F.lit(inserted).cast("string").alias("inserted"),
    )


def tokens(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(5))
def test_edits(seed):
    pick = random.Random(seed)

    def some(n):
        return "".join(pick.choice(PARTS) for _ in range(n))

    for _ in range(120):
        text = some(pick.choice([0, 1, 3, 20, 700]))
        tree = Tree.build(text, COUNT)
        for _ in range(4):
            start, removed = pick.randrange(len(text) + 2), pick.choice([0, 1, 2, 5, 100, 400])
            text, _ = tree.edit(text, start, removed, some(pick.choice([0, 1, 3, 300])), COUNT)
            tree = Tree.unpacked(*tree.packed())
            fresh = Tree.build(text, COUNT)
            assert np.concatenate(tree.lengths).tolist() == np.concatenate(fresh.lengths).tolist()
            assert np.concatenate(tree.tokens).tolist() == np.concatenate(fresh.tokens).tolist()
            assert tree.total == fresh.total == tokens(text)
            assert tree.length_sums[1] == len(text)


def test_an_edit_of_a_long_text_encodes_little():
    text = prose(1, 50_000)
    tree = Tree.build(text, COUNT)
    assert len(tree.lengths) > 500
    for place in (0, len(text) // 3, len(text) - 1):
        text, encoded = tree.edit(text, place, 7, "new words", COUNT)
        assert encoded < 20 and tree.total == tokens(text)


def test_blocks_that_grow_are_cut_again():
    tree = Tree.build("a b c", COUNT)
    tree.edit("a b c", 2, 0, " word" * 2000, COUNT)
    assert max(map(len, tree.lengths)) <= BLOCK and len(tree.token_sums) > 2


def test_odd_documents(odd):
    state = build_trees(odd)
    assert state.count() == len(ROWS)
    edits = F.array(change(1, 2, " in "), change(10**9, 5, None))
    edits = F.when(F.col("doc_id") == 1, F.lit(None)).otherwise(edits)
    edited = apply_edits(state.withColumn("edits", edits)).collect()
    assert len(edited) == len(ROWS)
    want = []
    for doc_id, text, *_ in ROWS:
        text = text or ""
        new = text if doc_id == 1 else text[:1] + " in " + text[3:]
        want.append((doc_id, new, tokens(text), tokens(new)))
    got = [(r.doc_id, r.text, r.n_before, r.n_tokens) for r in edited]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_state_may_be_edited_again(odd):
    def once(state):
        return apply_edits(state.withColumn("edits", F.array(change(0, 3, "x"))))

    twice = once(once(build_trees(odd)))
    assert all(r.n_tokens == tokens(r.text) for r in twice.collect())


def test_documents(spark):
    rows = {r.doc_id: r for r in op10_token_counts(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        text, n = r.text, len(r.text)
        tail = text[max(n - 100, 0) :][:33]
        text = text[: n // 2] + tail + text[n // 2 :]
        text = text[: n // 4] + text[n // 4 + 50 :]
        assert rows[r.doc_id].n_tokens == tokens(r.text)
        assert rows[r.doc_id].n_tokens_edited == tokens("> " + text)
        assert rows[r.doc_id].n_encoded < 120


def test_no_documents(nothing):
    assert build_trees(nothing).isEmpty()
