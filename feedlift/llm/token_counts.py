"""Token counts that follow edits without encoding whole texts again.

A document has a segment tree: its leaves are pre-tokens in blocks, each with its
length and its number of tokens; the nodes above hold the sums.  An edit is found by
descending the sums of lengths.  Pre-tokens are cut again from a few characters
before it until a cut falls where one was before; only the pre-tokens between are
encoded, and only the sums on the way up from their blocks change.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.llm.common import map_slices, read_table, text_or_empty
from feedlift.llm.encoding import PRE_TOKEN, Remembered, encoder, tokenizer_path

# A cut depends on at most two characters behind it; the rest is to spare.
CONTEXT = 4
BLOCK = 64


class Counter:
    """Pre-token to its number of tokens.  Special tokens' strings are ordinary text."""

    def __init__(self, path: str) -> None:
        self.of = Remembered(encoder(path).count, most=200_000).__getitem__


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _sums(blocks: list[np.ndarray]) -> np.ndarray:
    """A tree of sums: the blocks' own from the middle on, each node's two below it."""
    size = 1
    while size < len(blocks):
        size *= 2
    level = np.zeros(size, np.int64)
    level[: len(blocks)] = [block.sum() for block in blocks]
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    return np.concatenate([[0], *reversed(levels)]).astype(np.int64)


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


@dataclass
class Tree:
    """Pre-tokens of one text: lengths and token counts in blocks, and their sums."""

    lengths: list[np.ndarray]
    tokens: list[np.ndarray]
    length_sums: np.ndarray
    token_sums: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, tokens: np.ndarray) -> Tree:
        cuts = range(BLOCK, len(lengths), BLOCK)
        parts, counts = np.split(lengths, cuts), np.split(tokens, cuts)
        return cls(parts, counts, _sums(parts), _sums(counts))

    @classmethod
    def build(cls, text: str, count: Counter) -> Tree:
        pieces = PRE_TOKEN.findall(text)
        lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
        return cls.of(lengths, np.fromiter(map(count.of, pieces), np.int32, len(pieces)))

    @property
    def total(self) -> int:
        return int(self.token_sums[1])

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block with the character at ``place``, or the last one, and its start."""
        size, node, start = len(self.length_sums) // 2, 1, 0
        while node < size:
            node *= 2
            if place >= start + self.length_sums[node]:
                start += int(self.length_sums[node])
                node += 1
        block = node - size
        while block >= len(self.lengths) or (block and not len(self.lengths[block])):
            block -= 1
            start -= int(self.lengths[block].sum()) if block < len(self.lengths) else 0
        return block, start

    def _leaf_at(self, place: int) -> tuple[int, int, int]:
        """Block, number in it and start of the pre-token with the character at ``place``."""
        block, start = self._block_at(place)
        ends = start + np.cumsum(self.lengths[block])
        leaf = int(np.searchsorted(ends, place, side="right"))
        leaf = min(leaf, max(0, len(ends) - 1))
        return block, leaf, start if leaf == 0 else int(ends[leaf - 1])

    def _put(self, block: int, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Replaces a block, and the sums on its way up."""
        self.lengths[block], self.tokens[block] = lengths, tokens
        for sums, values in ((self.length_sums, lengths), (self.token_sums, tokens)):
            node = len(sums) // 2 + block
            sums[node] = values.sum()
            node //= 2
            while node:
                sums[node] = sums[2 * node] + sums[2 * node + 1]
                node //= 2

    def edit(
        self, text: str, start: int, removed: int, inserted: str, count: Counter
    ) -> tuple[str, int]:
        """The text with ``removed`` characters at ``start`` replaced, and how many
        pre-tokens were encoded for that."""
        start = min(max(0, start), len(text))
        removed = min(max(0, removed), len(text) - start)
        new = text[:start] + inserted + text[start + removed :]
        block, leaf, place = self._leaf_at(max(0, start - CONTEXT))
        first, first_leaf = block, leaf
        shift = len(inserted) - removed
        lengths, tokens = [], []
        at, old = place, place
        while True:
            # Cuts are the same from the first one behind the edit that both texts have.
            while old < at - shift and block < len(self.lengths):
                own = self.lengths[block]
                if leaf < len(own):
                    old += int(own[leaf])
                    leaf += 1
                else:
                    block, leaf = block + 1, 0
            if at >= start + len(inserted) and old == at - shift:
                break
            match = PRE_TOKEN.match(new, at)
            if match is None:
                break
            lengths.append(match.end() - at)
            tokens.append(count.of(match.group()))
            at = match.end()
        last = min(block, len(self.lengths) - 1)
        rest = leaf if block < len(self.lengths) else len(self.lengths[last])

        def joined(own: list[np.ndarray], fresh: list[int]) -> np.ndarray:
            parts = own[first][:first_leaf], np.array(fresh, np.int64), own[last][rest:]
            return np.concatenate(parts)

        new_lengths = joined(self.lengths, lengths)
        self._put(first, new_lengths, joined(self.tokens, tokens))
        empty = np.zeros(0, np.int64)
        for number in range(first + 1, last + 1):
            self._put(number, empty, empty)
        if len(new_lengths) > 4 * BLOCK:
            fresh = Tree.of(np.concatenate(self.lengths), np.concatenate(self.tokens))
            self.__dict__.update(fresh.__dict__)
        return new, len(lengths)

    def packed(self) -> tuple[bytes, ...]:
        sizes = np.array([len(block) for block in self.lengths])
        arrays = (sizes, np.concatenate(self.lengths), np.concatenate(self.tokens))
        return tuple(_narrow(array) for array in (*arrays, self.length_sums, self.token_sums))

    @classmethod
    def unpacked(cls, *packed: bytes) -> Tree:
        sizes, lengths, tokens, length_sums, token_sums = map(_wide, packed)
        cuts = np.cumsum(sizes)[:-1]
        return cls(np.split(lengths, cuts), np.split(tokens, cuts), length_sums, token_sums)


_TREE = ("sizes", "lengths", "tokens", "length_sums", "token_sums")
_STATE = "doc_id long, text string, n_tokens long, " + ", ".join(f"{name} binary" for name in _TREE)


def _state_batch(rows: list[tuple], more: dict[str, list[int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * len(_TREE))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
    arrays += [pa.array(values, pa.int64()) for values in more.values()]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_tokens", *_TREE, *more])


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The state of every row of ``docs``: its text, token count and tree.

    A null text is an empty one of no tokens.  Repeated rows and rows without an id
    have a state each; columns but ``doc_id`` and ``text`` are left behind.
    """
    path = path or tokenizer_path()

    def build(rows: list[dict]) -> pa.RecordBatch:
        out = []
        for row in rows:
            tree = Tree.build(row["text"], counter(path))
            out.append((row["doc_id"], row["text"], tree.total, *tree.packed()))
        return _state_batch(out, {})

    return map_slices(docs.select("doc_id", text_or_empty().alias("text")), build, _STATE)


def apply_edits(state: DataFrame, path: str | None = None) -> DataFrame:
    """The state after the ``edits`` of each row, in their order.

    ``edits`` is an array of ``start``, ``removed`` (in characters of the text as it
    then is; what lies outside it is left out) and ``inserted``, null for nothing.
    Adds ``n_before``, the count before; ``n_encoded``, pre-tokens that were encoded;
    and ``n_pieces``, pre-tokens there are.
    """
    path = path or tokenizer_path()

    def edit(rows: list[dict]) -> pa.RecordBatch:
        out, more = [], {"n_before": [], "n_encoded": [], "n_pieces": []}
        for row in rows:
            text, tree = row["text"], Tree.unpacked(*(row[name] for name in _TREE))
            more["n_before"].append(tree.total)
            encoded = 0
            for change in row["edits"] or ():
                place, inserted = (change["start"], change["removed"]), change["inserted"] or ""
                text, some = tree.edit(text, *place, inserted, counter(path))
                encoded += some
            more["n_encoded"].append(encoded)
            more["n_pieces"].append(sum(map(len, tree.lengths)))
            out.append((row["doc_id"], text, tree.total, *tree.packed()))
        return _state_batch(out, more)

    schema = _STATE + ", n_before long, n_encoded long, n_pieces long"
    return map_slices(state.select("doc_id", "text", *_TREE, "edits"), edit, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits made from its own text.

    The first third of a hundred characters from its end goes to its middle, half a
    hundred characters are cut out after a quarter, and a mark is put in front.
    """
    state = build_trees(read_table(spark, sf_dir, "documents"))
    n = F.char_length("text")

    def change(start, removed, inserted):
        return F.struct(
            F.floor(start).cast("long").alias("start"),
            F.lit(removed).cast("long").alias("removed"),
            inserted.alias("inserted"),
        )

    edits = F.array(
        change(n / 2, 0, F.substring("text", F.greatest(n - 99, F.lit(1)), F.lit(33))),
        change(n / 4, 50, F.lit(None).cast("string")),
        change(F.lit(0), 0, F.lit("> ")),
    )
    edited = apply_edits(state.withColumn("edits", edits))
    return edited.select(
        "doc_id",
        F.col("n_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        "n_encoded",
        "n_pieces",
        F.sha2("text", 256).alias("edited_sha256"),
    )
