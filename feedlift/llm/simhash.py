"""Near-duplicate documents by SimHash, found through Golay codewords.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits agree wholly in one segment at
least (pigeonhole), and differ in at most two bits in the segment after it.  That
second segment, filled up to 23 bits, is decoded in the perfect binary Golay code:
its keys are the indices of all codewords within four bits, one or six of them.
Two words two bits apart have a word between them that is one bit from both
and, as every word is, at most three bits from a codeword: so they share a key.
Fingerprints meet where a whole segment and a codeword index are equal, and are
then compared bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlift.llm.common import map_slices, read_table, written
from feedlift.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
MOST_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fingerprints with one key that are compared with each other; larger buckets
# are joined through the words between them, as exactly.
BUCKET = 64

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
LENGTH, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the one error of up to three bits, and the five of four bits if any."""
    syndrome = [_remainder(1 << bit) for bit in range(LENGTH)]
    near = np.zeros(1 << CHECKS, np.int64)
    far = np.zeros((1 << CHECKS, 5), np.int64)
    found = np.zeros(1 << CHECKS, np.int64)
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(LENGTH), weight):
            at, error = 0, 0
            for bit in bits:
                at ^= syndrome[bit]
                error |= 1 << bit
            if weight < 4:
                near[at] = error
            else:
                far[at, found[at]] = error
                found[at] += 1
    return near, far


_TABLES: list[np.ndarray] = []


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words, six indices each of the codewords within four bits, -1 where fewer."""
    if not _TABLES:
        low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
        high = np.array([_remainder(x << 12) for x in range(1 << CHECKS)], np.int64)
        _TABLES.extend((low, high, *_patterns()))
    low, high, near, far = _TABLES
    at = low[words & 0xFFF] ^ high[words >> 12]
    first = (words ^ near[at]) >> CHECKS
    more = far[at]
    rest = np.where(more > 0, (words[:, None] ^ more) >> CHECKS, -1)
    return np.concatenate([first[:, None], rest], axis=1)


def bucket_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the fingerprints that have them; ``fingerprints`` are signed 64-bit."""
    bits = fingerprints.view(np.uint64)
    parts = [
        ((bits >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for start, width in SEGMENTS
    ]
    keys, owners = [], []
    for number, part in enumerate(parts):
        index = codeword_indices(parts[(number + 1) % len(parts)])
        key = ((number << 22 | part) << 12)[:, None] | index
        keys.append(key[index >= 0])
        owners.append(np.broadcast_to(fingerprints[:, None], index.shape)[index >= 0])
    return np.concatenate(keys), np.concatenate(owners)


def words_between(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words at most one bit from a fingerprint: shared by two just if they are two apart."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    near = fingerprints.view(np.uint64)[:, None] ^ flips
    return near.reshape(-1).view(np.int64), np.repeat(fingerprints, 65)


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles as a signed number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fall, only ASCII blanks part
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        runs = zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)
        shingles = [b" ".join(run) for run in runs]
    counts = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 1 << 16):
        part = shingles[start : start + (1 << 16)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(counts * 2 > len(shingles), bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``fp`` and the whole-number columns ``keep`` of every row of ``docs``."""

    def prints(rows: list[dict]) -> pa.RecordBatch:
        columns = {name: [row[name] for row in rows] for name in ("doc_id", *keep)}
        columns["fp"] = [fingerprint(row["text"]) for row in rows]
        return pa.RecordBatch.from_pydict(columns, schema)

    names = ("doc_id", *keep, "fp")
    schema = pa.schema([(name, pa.int64()) for name in names])
    rows = docs.select("doc_id", "text", *keep)
    return map_slices(rows, prints, ", ".join(f"{name} long" for name in names))


def _spread(fps: DataFrame, function, name: str) -> DataFrame:
    """``fp`` with each value that ``function`` gives it."""

    def over(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(start, 4096).to_numpy(zero_copy_only=False)
                values, owners = function(own.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(owners)], [name, "fp"])

    return fps.select("fp").mapInArrow(over, f"{name} long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``u`` < ``v`` of distinct fingerprints that connect all within two bits.

    Two fingerprints with a path of links between them are connected by these
    pairs; in a large bucket not every link is listed.
    """
    keys = _spread(fps, bucket_keys, "key")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keys.join(sizes, "key"), "op8-buckets")
    few = met.where(F.col("n") <= BUCKET).select("key", "fp")
    left, right = few.withColumnRenamed("fp", "u"), few.withColumnRenamed("fp", "v")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS
    meets = (left["key"] == right["key"]) & (F.col("u") < F.col("v")) & close
    pairs = left.join(right, meets).select("u", "v").distinct()
    crowded = met.where(F.col("n") > BUCKET).select("fp").distinct()
    between = _spread(crowded, words_between, "word")
    # A word has 65 neighbours at most, so these groups are small however hot the bucket.
    stars = between.groupBy("word").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("fps"))
    starred = stars.where(F.size("fps") > 1).select("u", F.explode("fps").alias("v"))
    return pairs.unionByName(starred.where(F.col("u") != F.col("v")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included;
    fingerprints link at two or fewer differing bits.  Rows without words have the
    fingerprint zero and link like others.  A null text is empty.  Repeated
    rows get a row each.  A row without an id is a member of its component,
    but never names it: NULL where no member has an id.  Columns other than
    ``doc_id`` and ``text`` are not looked at.

    Equal fingerprints are one node, so that a group of copies, however large,
    is one row from the first aggregation on.
    """
    prints = written(fingerprints(docs), "op8-prints")
    return prints.join(_grouped(prints), "fp").select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame) -> DataFrame:
    """``fp``, the ``root`` fingerprint of its component and the least id that has one of it."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "op8-nodes")
    roots = components(links(nodes))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = labelled.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return labelled.join(least, "root").select("fp", "root", "component_id")


def _row_keys(names: list[str]) -> list[Column]:
    """Two numbers that tell a row from others by all its columns."""
    others = [F.col(f"`{name}`") for name in names if name not in ("doc_id", "text")]
    told = F.to_json(F.struct(*others)) if others else F.lit("")
    return [F.xxhash64(F.lit(seed), "doc_id", "text", told).alias(f"key_{seed}") for seed in (1, 2)]


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id.

    Groups are those of :func:`near_duplicates`: texts, whatever their ids.  Of rows that
    share the smallest id a hash of the whole row chooses one; a row without an id stays only
    where no row of its group has one.  So each group leaves one row, also where other
    texts share its ids, and where the same row is there many times.  Columns may have any
    name and are as they were.

    Rows that are the same are one before any row is moved; what is joined with them
    is a key for each group.
    """
    keys = ["doc_id", "key_1", "key_2"]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"), "text",
                        *_row_keys(docs.columns))
    prints = written(fingerprints(keyed, "key_1", "key_2"), "op8-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *keys)).alias("first")
    firsts = prints.join(_grouped(prints), "fp").groupBy("root").agg(first)
    firsts = firsts.select(*(F.col(f"first.{key}").alias(f"first_{key}") for key in keys))
    rows = keyed.groupBy(*keys).agg(F.any_value("row").alias("row"))
    met = F.lit(True)
    for key in keys:
        met = met & rows[key].eqNullSafe(firsts[f"first_{key}"])
    return rows.join(firsts, met, "left_semi").select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
