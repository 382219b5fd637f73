"""Tokens of two vocabularies over the same bytes, linked where they share bytes or groups.

Each vocabulary's tokens are the rows of a sparse matrix over the bytes of the text.
Gustavson's row-by-row product of the one with the transposed other has an entry for
each two tokens that overlap.  Where the last token that a row overlaps is not the first
one of the next row, both vocabularies end a token: there groups are cut.  The product of
the two matrices of tokens by groups then links all tokens of a group.

In front of a blank between other characters both vocabularies begin a token.  So texts are
cut there, a part that comes again is multiplied once, and a block of new parts is one
product: its matrices are block-diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedlift.llm.common import read_table, text_or_empty, written
from feedlift.llm.encoding import Encoder, parts_of, tokenizer_path
from feedlift.llm.sentencepieces import PIECE_BPE, piece_encoder

# Parts a worker remembers, of so many characters at most.
MOST_PARTS = 300_000
LONGEST_PART = 48
# Documents of a batch that are Python objects at one time.
SLICE_ROWS = 128
# Counts of pairs that are broadcast; the others, of rarer pairs, are joined by a shuffle.
MOST_BROADCAST = 500_000


@dataclass
class Csr:
    """A sparse matrix of whole numbers, row by row, columns of a row in order."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_rows(cls, sizes: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        """Ones in ``columns``, so many in each row."""
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return cls(starts, columns, np.ones(len(columns), np.int64), width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        sizes = np.bincount(self.columns, minlength=self.width)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return Csr(starts, self.rows()[order], self.values[order], len(self))

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each row is the sum of the rows of ``other`` its entries name."""
        sizes = np.diff(other.starts)[self.columns]
        entry = np.repeat(np.arange(len(self.columns)), sizes)
        within = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        met = other.starts[self.columns[entry]] + within
        key = self.rows()[entry] * other.width + other.columns[met]
        value = self.values[entry] * other.values[met]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        value = np.add.reduceat(value, firsts) if len(firsts) else value
        row, column = np.divmod(key[firsts], max(1, other.width))
        starts = np.searchsorted(row, np.arange(len(self) + 1))
        return Csr(starts, column, value, other.width)


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Csr:
    """How many bytes each token of ``a`` shares with each of ``b``, over the same bytes."""
    total = int(a_sizes.sum())
    a = Csr.of_rows(a_sizes, np.arange(total), total)
    b = Csr.of_rows(b_sizes, np.arange(total), total)
    return a.times(b.transposed())


def groups_of(shared: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side: cut where both end a token."""
    first = shared.columns[shared.starts[:-1]]
    last = shared.columns[shared.starts[1:] - 1]
    a_group = np.concatenate([[0], np.cumsum(first[1:] != last[:-1])])[: len(first)]
    b_group = np.zeros(shared.width, np.int64)
    b_group[shared.columns] = a_group[shared.rows()]
    return a_group, b_group


def links_of(a_group: np.ndarray, b_group: np.ndarray) -> Csr:
    """An entry for each two tokens of one group."""
    count = int(a_group[-1]) + 1 if len(a_group) else 0
    a = Csr.of_rows(np.ones(len(a_group), np.int64), a_group, count)
    b = Csr.of_rows(np.ones(len(b_group), np.int64), b_group, count)
    return a.times(b.transposed())


class Aligner:
    """Parts of texts in both vocabularies."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self._a, self._b = Encoder(a_path, most=100_000), piece_encoder(b_path)
        self._a_bytes, self._b_bytes = self._a.token_bytes(), self._b.token_bytes()
        self._a_sizes = np.array([len(one) for one in self._a_bytes])
        self._b_sizes = np.array([len(one) for one in self._b_bytes])
        # Ids as text with what follows them inside of a group, and at its end.
        self._a_names, self._b_names = (
            np.array([[b"%d%b" % (n, mark) for n in range(len(ids))] for mark in marks], object)
            for ids, marks in ((self._a_bytes, (b",", b"|")), (self._b_bytes, (b",", b";")))
        )
        # Their sizes, with the mark.
        self._a_digits, self._b_digits = (
            np.array([len(name) for name in names[0]]) for names in (self._a_names, self._b_names)
        )
        self.b_count = len(self._b_bytes)
        self._forget()

    def _forget(self) -> None:
        # Of each part, by its number: sizes, groups as text, linked pairs as 64-bit numbers.
        self._numbers: dict[str, int] = {}
        self._sizes = np.zeros((0, 5), np.int64)
        self._groups: list[bytes] = []
        self._pairs: list[bytes] = []

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        return parts_of(text) if self._b.cuts else [text]

    @staticmethod
    def _given_back(
        told: list[bytes], packed: list[bytes], stands: list[bytes], sizes: np.ndarray
    ) -> np.ndarray:
        """Whether the ids of each part, as 32-bit numbers, stand for its very bytes."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        ends = np.cumsum(sizes[ids])[np.cumsum([len(one) // 4 for one in packed]) - 1]
        back = b"".join(map(stands.__getitem__, ids.tolist()))
        if back == b"".join(told) and (ends == np.cumsum([len(one) for one in told])).all():
            return np.ones(len(told), bool)
        each = (np.frombuffer(one, "<u4").tolist() for one in packed)
        back = [b"".join(map(stands.__getitem__, one)) for one in each]
        return np.array([one == other for one, other in zip(back, told, strict=True)])

    def _learn(self, parts: list[str]) -> None:
        """Multiplies parts that are new, all in one product."""
        a_packed = list(map(self._a.after_blank, parts))
        b_packed = self._b.encode_parts(parts)
        told = [(" " + part).encode() for part in parts]
        whole = self._given_back(told, a_packed, self._a_bytes, self._a_sizes)
        whole &= self._given_back(told, b_packed, self._b_bytes, self._b_sizes)
        for number in np.flatnonzero(~whole):
            a_packed[number] = b_packed[number] = b""
        a, b = (np.frombuffer(b"".join(some), "<u4").astype(np.int64)
                for some in (a_packed, b_packed))
        a_counts, b_counts = (np.array([len(one) // 4 for one in some])
                              for some in (a_packed, b_packed))
        a_group, b_group = groups_of(overlaps(self._a_sizes[a], self._b_sizes[b]))
        links = links_of(a_group, b_group)
        pairs = (a[links.rows()] * self.b_count + b[links.columns]).tobytes()
        names, name_ends = self._named(a, b, a_group, b_group)

        # Of each part, the ends of its groups, links and names, from those of its last token.
        a_ends = np.cumsum(a_counts)
        n_groups = np.concatenate([[0], a_group + 1])[a_ends]
        n_links = links.starts[a_ends]
        n_names = name_ends[a_ends + np.cumsum(b_counts)].tolist()
        # A mark that no id follows is left out.
        self._groups += [names[i : max(i, j - 1)] for i, j in zip([0, *n_names], n_names)]
        link_ends = (8 * n_links).tolist()
        self._pairs += [pairs[i:j] for i, j in zip([0, *link_ends], link_ends)]
        first = len(self._sizes)
        sizes = (a_counts, b_counts, np.diff(n_groups, prepend=0), np.diff(n_links, prepend=0))
        self._sizes = np.concatenate([self._sizes, np.column_stack([*sizes, ~whole])])
        self._numbers.update(zip(parts, range(first, first + len(parts))))

    def _named(
        self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray
    ) -> tuple[bytes, np.ndarray]:
        """All ids as text, those of a group of either side one after another, with their marks.

        Also where the first, the second and so on of them begin and the last one ends.
        """
        count = int(a_group[-1]) + 1 if len(a_group) else 0
        # How many tokens of the one side stand before those of a group of the other.
        a_before = np.searchsorted(a_group, np.arange(1, count + 1))
        b_before = np.searchsorted(b_group, np.arange(count))
        out = np.empty(len(a) + len(b), object)
        sizes = np.zeros(len(out) + 1, np.int64)
        for ids, group, before, names, digits in (
            (a, a_group, b_before, self._a_names, self._a_digits),
            (b, b_group, a_before, self._b_names, self._b_digits),
        ):
            last = np.append(group[1:] != group[:-1], True)[: len(group)].astype(np.int64)
            places = np.arange(len(ids)) + before[group]
            out[places] = names[last, ids]
            sizes[places + 1] = digits[ids]
        return b"".join(out.tolist()), np.cumsum(sizes)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], list[tuple]]:
        """Sizes, groups, and distinct linked pairs with how often, of each text."""
        if len(self._sizes) > MOST_PARTS:
            self._forget()
        all_parts = [self._parts(text) for text in texts]
        new = {part for parts in all_parts for part in parts if part not in self._numbers}
        if new:
            self._learn(sorted(new))
        sizes = np.zeros((len(texts), 4), np.int64)
        groups, pairs = [], []
        for row, parts in enumerate(all_parts):
            numbers = list(map(self._numbers.__getitem__, parts))
            summed = self._sizes[numbers].sum(axis=0)
            if summed[4] or not parts:
                numbers = []
            else:
                sizes[row] = summed[:4]
            groups.append(b";".join(map(self._groups.__getitem__, numbers)))
            linked = b"".join(map(self._pairs.__getitem__, numbers))
            pairs.append(np.unique(np.frombuffer(linked, "<i8"), return_counts=True))
        for part in new:
            if len(part) > LONGEST_PART:
                number = self._numbers.pop(part)
                self._groups[number] = self._pairs[number] = b""
        return sizes, groups, pairs


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    key = a_path, b_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = (
    "row long, doc_id long, "
    + ", ".join(f"{name} long" for name in _SIZES)
    + ", groups string, links array<struct<pair: long, times: int>>"
)
_LINK = pa.struct([("pair", pa.int64()), ("times", pa.int32())])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Tokens, groups and links of every text behind a blank, in both vocabularies.

    ``row`` is a number of its own for every row, so that repeated ids, or none, are no
    matter.  ``groups`` lists the ids of each group; ``links`` has the distinct linked pairs,
    ``a * (ids of b) + b``, and how many times each is linked there.  A text that is null
    or empty, or that one of the vocabularies does not give back byte by byte, has no
    tokens: zeros, an empty text, no links.  Other columns than ``doc_id`` and ``text`` are
    left behind, whatever their names.  Tasks work on what they read.
    """
    a_path, b_path = a_path or tokenizer_path(), b_path or tokenizer_path(PIECE_BPE)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sizes, groups, pairs = both.align(part.column("text").to_pylist())
                ends = np.cumsum([0, *(len(found) for found, _ in pairs)])
                found = np.concatenate([found for found, _ in pairs])
                times = np.concatenate([times for _, times in pairs]).astype(np.int32)
                links = pa.StructArray.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(times, pa.int32())], fields=list(_LINK)
                )
                arrays = [
                    pa.array(np.arange(row, row + len(groups)), pa.int64()),
                    part.column("doc_id"),
                    *(pa.array(sizes[:, number], pa.int64()) for number in range(len(_SIZES))),
                    pa.array([group.decode() for group in groups], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links),
                ]
                names = ["row", "doc_id", *_SIZES, "groups", "links"]
                row += len(groups)
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(over, _ALIGNED)


def pair_counts(aligned: DataFrame, b_count: int) -> DataFrame:
    """``pair``, the ``docs`` that hold it linked, and whether that is the ``best`` of its A id."""
    held = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair")
    held = held.agg(F.count(F.lit(1)).alias("docs"))
    most = F.max("docs").over(
        Window.partitionBy(F.call_function("div", F.col("pair"), F.lit(b_count).cast("long")))
    )
    return held.select("pair", "docs", (F.col("docs") == most).alias("best"))


def _power(docs: Column) -> Column:
    """The power of two that a count reaches."""
    return (F.length(F.bin(docs)) - 1).cast("int")


def link_sums(aligned: DataFrame, counts: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``n_best`` and ``count_sum`` over the links of each ``row`` that has any.

    The pairs of the largest counts, ``most`` of them at most, hold nearly all links
    and are broadcast.  The others are joined by a shuffle, and each is in few documents,
    so none of them is a hot key.  What comes to the driver is a row for each power of two.
    """
    sizes = dict(counts.groupBy(_power(F.col("docs"))).count().collect())
    power = max(sizes, default=-1) + 1
    taken = 0
    while power > 0 and taken + sizes.get(power - 1, 0) <= most:
        power -= 1
        taken += sizes.get(power, 0)
    frequent = F.broadcast(counts.where(F.col("docs") >= 2**power))
    links = aligned.select("row", F.inline("links"))
    parts = [links.join(frequent, "pair")]
    if taken < sum(sizes.values()):
        rare = counts.where(F.col("docs") < 2**power)
        parts.append(links.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair"))
    sums = [
        part.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
        )
        for part in parts
    ]
    if len(sums) == 1:
        return sums[0]
    both = sums[0].unionByName(sums[1]).groupBy("row")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every document's alignment, and how common its links are in all documents."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align(read_table(spark, sf_dir, "documents"))
    aligned = aligned.withColumn("groups_sha256", digest).drop("groups")
    aligned = written(aligned, "aligned", compression="zstd")
    b_count = piece_encoder(tokenizer_path(PIECE_BPE)).library.get_piece_size()
    counts = written(pair_counts(aligned, b_count), "pair-counts")
    sums = link_sums(aligned, counts)
    return (
        aligned.drop("links")
        .join(sums, "row", "left")
        .na.fill(0, ["n_best", "count_sum"])
        .select("doc_id", *_SIZES, "n_best", "count_sum", "groups_sha256")
    )
