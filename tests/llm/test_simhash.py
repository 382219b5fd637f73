"""op8: codewords, links and components against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from feedlift.llm import simhash
from feedlift.llm.components import components
from feedlift.llm.simhash import (
    bucket_keys,
    codeword_indices,
    fingerprint,
    keep_one,
    links,
    near_duplicates,
)

from .conftest import ROWS, prose, table


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def plain_components(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    found = roots({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    members = defaultdict(list)
    for d, f in prints:
        if d is not None:
            members[found[f]].append(d)
    return sorted(((d, f, min(members[found[f]], default=None)) for d, f in prints), key=repr)


def unsigned(rows):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize("text", [r[1] for r in ROWS] + ["A b", "a b c d", "É É é", "a\x1cb c d"])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_words_two_bits_apart_share_a_codeword():
    pick = random.Random(1)
    for _ in range(3000):
        word = pick.getrandbits(23)
        other = word
        for bit in pick.sample(range(23), pick.randrange(3)):
            other ^= 1 << bit
        one, two = (set(codeword_indices(np.array([w]))[0].tolist()) - {-1} for w in (word, other))
        assert one & two and len(one) in (1, 6)


def test_prints_two_bits_apart_share_a_bucket():
    pick = random.Random(2)
    for _ in range(1000):
        one = pick.getrandbits(64)
        two = one
        for bit in pick.sample(range(64), pick.randrange(3)):
            two ^= 1 << bit
        pair = np.array([one, two], np.uint64).view(np.int64)
        keys = [set(bucket_keys(pair[i : i + 1])[0].tolist()) for i in range(2)]
        assert keys[0] & keys[1]


def crowd(size, seed=3):
    """Fingerprints around a few centres: chains, stars and strangers."""
    pick = random.Random(seed)
    out = set()
    for centre in [pick.getrandbits(64) for _ in range(size // 40 + 1)]:
        at = centre
        for _ in range(20):
            at ^= 1 << pick.randrange(64)
            out.add(at)
            out.add(centre ^ 1 << pick.randrange(64) ^ 1 << pick.randrange(64))
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_connect_what_is_close(spark, monkeypatch, bucket):
    """In small buckets and, by the words between, in large ones."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = crowd(200)
    found = components(links(spark.createDataFrame([(p,) for p in prints], "fp long")))
    got = {p: p for p in prints} | {r.node: r.root for r in found.collect()}
    assert got == roots(prints, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)


CHAIN, STAR = [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)]


@pytest.mark.parametrize("edges", [[], [(5, 5)], CHAIN, STAR])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "u long, v long"))
    nodes = {n for edge in edges for n in edge}
    want = roots(nodes, lambda a, b: (a, b) in edges)
    assert {r.node: r.root for r in found.collect()} == {n: r for n, r in want.items() if n != r}


def test_odd_documents(spark, odd):
    got = unsigned(near_duplicates(odd).collect())
    assert got == plain_components([r[:2] for r in ROWS])


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = unsigned(near_duplicates(docs).collect())
    assert got == plain_components([(r.doc_id, r.text) for r in docs.collect()])


def plain_first_rows(rows):
    """For each group of fingerprints that links connect, the ids its row may have."""
    prints = [(doc_id, plain_fingerprint(text)) for doc_id, text in rows]
    near = roots({fp for _, fp in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for doc_id, fp in prints:
        groups.setdefault(near[fp], []).append(doc_id)
    return [min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values()]


def test_one_of_each_group_stays(spark, odd):
    kept = keep_one(spark, odd, "")
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    want = plain_first_rows([r[:2] for r in ROWS])
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert kept.exceptAll(odd).isEmpty()


def test_texts_of_one_id_are_told_apart(spark):
    one, two = prose(1, 60), prose(2, 60)
    docs = table(spark, [(5, one), (5, two), (3, two), (None, one), (5, one), (None, "alone")])
    kept = sorted(((r.doc_id, r.text) for r in keep_one(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(5, one), (3, two), (None, "alone")], key=repr)


def test_any_column_names(spark):
    names = "row fp root node key key_1 key_2 first first_id component_id first_doc_id u v n word"
    docs = table(spark, [(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(3, 60))])
    docs = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in names.split()),
                           "map('a', doc_id) AS `a.b c`")
    kept = keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    rows = {row.doc_id: row for row in docs.collect()}
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert all(row == rows[row.doc_id] for row in kept.collect())


def test_a_large_group_of_copies(spark):
    docs = table(spark, [(i, prose(4, 50)) for i in range(2000)] + [(5000, prose(5, 50))])
    assert sorted(r.doc_id for r in keep_one(spark, docs, "").collect()) == [0, 5000]


def test_no_documents(spark, nothing):
    assert near_duplicates(nothing).isEmpty() and keep_one(spark, nothing, "").isEmpty()
