"""Documents packed into sequences by Karmarkar-Karp multiway differencing.

A document's full windows are sequences of their own.  What is left of it is cut
into parts, and the parts of many documents are divided among windows: each part
begins as a partition of its own, and the two partitions with the largest
differences are merged with opposing imbalances, the fullest window of one onto the
emptiest of the other, until one partition is left.  If a window is then over
capacity, the division is done again with one window more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.llm.common import SLICE_ROWS, read_table
from feedlift.llm.encoding import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 0
# A document's rest is halved down to parts of so many tokens at most.
LEAST_PART = 32
# Parts that are divided together, a few hundred windows full.
POOL = 2048

_COLUMNS = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(),
    "offset": pa.int64(),
    "ids": pa.binary(),
}
SCHEMA = ", ".join(f"{name} {'binary' if name == 'ids' else 'long'}" for name in _COLUMNS)


def divide(sizes: list[int], windows: int) -> list[list[int]]:
    """Numbers of ``sizes`` divided among ``windows`` of near-equal sums."""
    # A node is a part, or two nodes that came into one window.  A partition lists its
    # windows that are not empty as (sum, node), the emptiest first.
    left, right = list(range(len(sizes))), [-1] * len(sizes)
    heap = [(-size, number, [(size, number)]) for number, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        joined = one + two
        both = len(joined) - windows
        if both > 0:
            # The fullest windows of each meet empty ones of the other; of the others, so
            # many of each, the fullest meets the emptiest.
            joined = one[both:] + two[both:]
            for (a, node), (b, other) in zip(reversed(one[:both]), two[:both], strict=True):
                joined.append((a + b, len(left)))
                left.append(node)
                right.append(other)
        joined.sort()
        least = joined[0][0] if len(joined) == windows else 0
        heapq.heappush(heap, (least - joined[-1][0], turn, joined))
        turn += 1
    out = []
    for _, root in heap[0][2] if heap else []:
        parts, stack = [], [root]
        while stack:
            node = stack.pop()
            if right[node] < 0:
                parts.append(left[node])
            else:
                stack += (right[node], left[node])
        out.append(parts)
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As :func:`divide`, with one window more as long as one is over ``capacity``."""
    count = -(-sum(sizes) // capacity)
    while True:
        found = divide(sizes, count)
        if all(sum(sizes[i] for i in window) <= capacity for window in found):
            return found
        count += 1


def _parts(length: int) -> list[int]:
    """A rest in halves of halves: large parts come to windows first, small ones even them out."""
    parts = []
    while length > LEAST_PART:
        parts.append(length - length // 2)
        length //= 2
    return [*parts, length] if length else parts


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of sequences: what of which document stands where, and its ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers; id 0 ends each document, and
    each of its ids is in one piece.  A null text is an empty one: only the end.
    Every row is a document of its own, repeated or without an id or not.  Other
    columns than ``doc_id`` and ``text`` are not looked at.

    Tasks pack what they read, some thousand parts at a time, and nothing is
    shuffled: each task may leave its last window short.  Sequences are numbered by task,
    so that numbers are unique and a task that runs again gives the same.
    """
    path = path or tokenizer_path()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        following = TaskContext.get().partitionId() << 33
        out: dict[str, list] = {name: [] for name in _COLUMNS}
        pool: list[tuple[int | None, int, int, np.ndarray]] = []

        def put(piece: tuple[int | None, int, int, np.ndarray], offset: int) -> None:
            doc_id, start, total, ids = piece
            row = (doc_id, start, len(ids), total, following, offset, ids.tobytes())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            typed = zip(out.values(), _COLUMNS.values(), strict=True)
            arrays = [pa.array(values, kind) for values, kind in typed]
            for column in out.values():
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, list(_COLUMNS))

        def divided() -> None:
            nonlocal following
            for window in windows_of([len(piece[3]) for piece in pool]):
                offset = 0
                for number in window:
                    put(pool[number], offset)
                    offset += len(pool[number][3])
                following += 1
            pool.clear()

        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(first, SLICE_ROWS).to_pylist():
                    ids = np.append(encode(row["text"] or ""), np.uint32(END_ID))
                    start = 0
                    while len(ids) - start >= CAPACITY:
                        put((row["doc_id"], start, len(ids), ids[start : start + CAPACITY]), 0)
                        following += 1
                        start += CAPACITY
                        if len(out["ids"]) >= POOL:
                            yield flush()
                    for size in _parts(len(ids) - start):
                        pool.append((row["doc_id"], start, len(ids), ids[start : start + size]))
                        start += size
                    if len(pool) >= POOL:
                        divided()
                        yield flush()
        divided()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(over, SCHEMA)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
