"""Texts to piece ids of a merge-type vocabulary and back.

The symbols of a text are merged by an agenda: every pair of neighbours that together
are a piece waits there, the best score first, the leftmost of equal ones before the
others.  The pair that is taken becomes one symbol and puts its two new pairs on the
agenda; entries whose symbols have changed meanwhile are passed over.  Symbols that are no
piece are written as bytes.

No piece has a blank behind another character: in front of blanks a text is cut, and each
part has an agenda of its own and is remembered.  The short parts that are new in
an Arrow batch have theirs side by side, as rows of one table of scores, of which each
turn takes the best of every row.  The sentencepiece library encodes the new parts too,
and what it decodes of each document is held against its text.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.llm.common import SLICE_ROWS, read_table, text_or_empty
from feedlift.llm.encoding import tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
# How a vocabulary writes a blank; a fixed value.
BLANK = "▁"
# Rests of texts behind such a blank begin a part.
_PARTING = re.compile(r"(?<=[^ ]) ")
# What a worker remembers: so many parts, of so many characters at most.
MOST_PARTS = 800_000
LONGEST_PART = 48
# Parts up to this length have their agendas side by side.
LONGEST_ROW = 32
_BLANK_INSIDE = re.compile(f"[^{BLANK}]{BLANK}")
# A vocabulary that encodes these otherwise has rules that are not known here.
_PROBES = ("", " ", "  a b  c ", f"a{BLANK}b", "ﬁ Á　x\x00\t\n", "<s></s><unk><0x41>")


class PieceEncoder:
    """Piece ids of texts by one vocabulary of the library's merge type."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._ids, byte_ids, scores = {}, {}, {}
        for number in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(number)
            if self.library.is_byte(number):
                byte_ids[int(piece[1:-1], 16)] = number
            elif not (self.library.is_control(number) or self.library.is_unknown(number)):
                self._ids[piece] = number
                scores[piece] = self.library.get_score(number)
        # Scores by their place: 0 is the best.
        places = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self._order = {piece: places[score] for piece, score in scores.items() if len(piece) > 1}
        self._bytes = [byte_ids.get(byte, self.library.unk_id()) for byte in range(256)]
        self.cuts = not any(_BLANK_INSIDE.search(piece) for piece in self._ids)
        self._number_pairs()
        self._parts: dict[str, bytes] = {}
        self._wrong: set[str] = set()
        told = [self.library.encode(probe) for probe in _PROBES]
        if [self.ids(probe).tolist() for probe in _PROBES] != told:
            raise ValueError(f"{path} is not a plain merge-type vocabulary")

    def _number_pairs(self) -> None:
        """Symbols as numbers, and for each pair of them that is a piece its place and number."""
        # ASCII that is in no piece is written as one byte: such symbols have numbers, too.
        ascii_bytes = {chr(byte): number for byte, number in enumerate(self._bytes[:128])}
        single = {symbol for piece in self._ids for symbol in piece} | ascii_bytes.keys()
        symbols = [*self._ids, *sorted(single - self._ids.keys())]
        numbers = {symbol: number for number, symbol in enumerate(symbols)}
        # A character of no piece has the last number, which is in no pair.
        self._none = len(symbols)
        self._of_character = np.full(sys.maxunicode + 1, self._none, np.int32)
        for symbol in single:
            self._of_character[ord(symbol)] = numbers[symbol]
        alone = ascii_bytes | self._ids
        self._piece_ids = np.array([alone.get(symbol, -1) for symbol in symbols] + [-1], "<i4")
        pairs = sorted(
            (numbers[piece[:cut]] * (self._none + 1) + numbers[piece[cut:]], place, numbers[piece])
            for piece, place in self._order.items()
            for cut in range(1, len(piece))
            if piece[:cut] in numbers and piece[cut:] in numbers
        )
        ends = [(-1, 0, 0)] if pairs else [(-1, 0, 0), (-2, 0, 0)]
        table = np.array(sorted(ends + pairs), np.int64)
        self._pairs = np.ascontiguousarray(table[:, 0])
        self._pair_places, self._pair_numbers = table[:, 1].astype("i4"), table[:, 2].astype("i4")

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where pairs of symbols are listed, 0 for those that are not."""
        wanted = left.astype(np.int64) * (self._none + 1) + right
        at = np.searchsorted(self._pairs, wanted)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == wanted, at, 0)

    def _rows(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of one length, the best pair of every row merged in each turn."""
        width = len(texts[0])
        characters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        symbols = self._of_character[characters].reshape(-1, width)
        last = np.int32(np.iinfo(np.int32).max)
        pairs = self._find(symbols[:, :-1], symbols[:, 1:])
        # One column more, always empty, keeps neighbours of the last symbol in the table.
        agenda = np.full((len(texts), width), last)
        agenda[:, :-1] = np.where(pairs > 0, self._pair_places[pairs], last)
        symbols = np.column_stack([symbols, np.full(len(texts), self._none, np.int32)])
        left_over = np.full(len(texts), width)
        rows = np.arange(len(texts))
        columns = np.arange(width)
        while True:
            best = agenda[rows].argmin(axis=1)
            going = agenda[rows, best] != last
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            known = self._find(symbols[rows, best], symbols[rows, best + 1])
            # What stands behind the pair moves up one place.
            shift = columns + (columns > best[:, None])
            old_symbols, old_agenda = symbols[rows], agenda[rows]
            moved = np.take_along_axis(old_symbols, shift, axis=1)
            at = np.arange(len(rows))
            moved[at, best] = self._pair_numbers[known]
            waiting = np.take_along_axis(old_agenda, np.minimum(shift, width - 1), axis=1)
            waiting[:, -1] = last
            symbols[rows, :-1] = moved
            symbols[rows, -1] = self._none
            behind = self._find(moved[at, best], symbols[rows, best + 1])
            waiting[at, best] = np.where(behind > 0, self._pair_places[behind], last)
            ahead = self._find(moved[at, best - 1], moved[at, best])
            first = best > 0
            value = np.where(ahead > 0, self._pair_places[ahead], last)
            waiting[at[first], best[first] - 1] = value[first]
            agenda[rows] = waiting
            left_over[rows] -= 1
        inside = columns < left_over[:, None]
        numbers = self._piece_ids[symbols[:, :-1]]
        strange = ((numbers < 0) & inside).any(axis=1)
        packed = numbers[inside].astype("<i4").tobytes()
        ends = (4 * np.cumsum(left_over)).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends)]
        for row in np.flatnonzero(strange):
            out[row] = self._one(texts[row])
        return out

    def symbols(self, text: str) -> list[str]:
        """What the agenda leaves of ``text``, whose blanks are written as the vocabulary does."""
        order = self._order.get
        pieces: list[str | None] = list(text)
        end = len(pieces)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        # An entry is place of the score and place of the left symbol in one number.
        bits = end.bit_length()
        agenda = [
            place << bits | left
            for left, pair in enumerate(map(str.__add__, text, text[1:]))
            if (place := order(pair)) is not None
        ]
        agenda.sort()
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & (1 << bits) - 1
            if pieces[left] is None or (right := after[left]) == end:
                continue
            merged = pieces[left] + pieces[right]
            if order(merged) != entry >> bits:
                continue
            pieces[left], pieces[right] = merged, None
            beyond = after[left] = after[right]
            if beyond < end:
                before[beyond] = left
                if (place := order(merged + pieces[beyond])) is not None:
                    heapq.heappush(agenda, place << bits | left)
            if (ahead := before[left]) >= 0:
                if (place := order(pieces[ahead] + merged)) is not None:
                    heapq.heappush(agenda, place << bits | ahead)
        return [piece for piece in pieces if piece is not None]

    def _one(self, text: str) -> bytes:
        """Ids of one text by an agenda of its own."""
        ids: list[int] = []
        for symbol in self.symbols(text):
            number = self._ids.get(symbol)
            if number is None:
                ids += map(self._bytes.__getitem__, symbol.encode())
            else:
                ids.append(number)
        return array("i", ids).tobytes()

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of a blank and each part, as 32-bit numbers."""
        texts = [BLANK + part.replace(" ", BLANK) for part in parts]
        out = [b""] * len(texts)
        same: dict[int, list[int]] = {}
        for number, text in enumerate(texts):
            if len(text) > LONGEST_ROW:
                out[number] = self._one(text)
            else:
                same.setdefault(len(text), []).append(number)
        for numbers in same.values():
            found = self._rows([texts[number] for number in numbers])
            for number, ids in zip(numbers, found, strict=True):
                out[number] = ids
        return out

    def parts(self, text: str) -> list[str]:
        """Parts that are each encoded behind a blank, as if they were a text of their own."""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if not text or not self.cuts:
            return [text] if text else []
        plain = "  " not in text and text[0] != " "
        return text.split(" ") if plain else _PARTING.split(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_parts(self.parts(text))), "<i4")

    def checked(self, texts: list[str], check: bool = True) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, as 32-bit numbers, and whether the library has the same.

        What is remembered is forgotten when it is ``MOST_PARTS`` parts.
        """
        if len(self._parts) > MOST_PARTS:
            self._parts.clear()
        all_parts = [self.parts(text) for text in texts]
        known = self._parts
        new = list({part for parts in all_parts for part in parts if part not in known})
        found = dict(zip(new, self.encode_parts(new), strict=True))
        if check and new:
            told = self.library.encode(new, num_threads=1)
            for part, ids in zip(new, told, strict=True):
                # The library has nothing for an empty text; here a blank stands before it.
                if part and array("i", ids).tobytes() != found[part]:
                    self._wrong.add(part)
        known.update(found)
        out = [b"".join(map(known.__getitem__, parts)) for parts in all_parts]
        for part in new:
            if len(part) > LONGEST_PART:
                del known[part]
        return out, [self._wrong.isdisjoint(parts) for parts in all_parts]

    def token_bytes(self) -> list[bytes]:
        """What each id stands for in a text; nothing for controls."""
        out = [b""] * self.library.get_piece_size()
        for piece, number in self._ids.items():
            out[number] = piece.replace(BLANK, " ").encode()
        for byte, number in enumerate(self._bytes):
            if number != self.library.unk_id():
                out[number] = bytes([byte])
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_ENCODED = "doc_id long, ids array<int>, agrees boolean, decoded string"


def encode_pieces(docs: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """``doc_id``, the ``ids`` of each whole text, and what they ``decoded`` to.

    ``agrees`` tells whether the library encodes the text's parts to the same ids and
    decodes these to the text; NULL where ``check`` is off.  A null text is an empty one,
    which has no ids.  Every row is a document, repeated or without an id or not; other
    columns than ``doc_id`` and ``text`` are left behind, whatever their names.  A narrow
    step: nothing is shuffled, and a task that runs again gives the same.
    """
    path = path or tokenizer_path(PIECE_BPE)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = part.column("text").to_pylist()
                packed, agrees = encoder.checked(texts, check)
                ids = [np.frombuffer(one, "<i4").tolist() for one in packed]
                decoded = encoder.library.decode(ids, num_threads=1)
                if check:
                    plain = (text.replace(BLANK, " ") for text in texts)
                    agrees = [a and t == d for a, t, d in zip(agrees, plain, decoded, strict=True)]
                else:
                    agrees = [None] * len(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype("<i4")
                numbers = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
                arrays = [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers),
                    pa.array(agrees, pa.bool_()),
                    pa.array(decoded, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "agrees", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(over, _ENCODED)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every document and of their decoded text."""
    encoded = encode_pieces(read_table(spark, sf_dir, "documents"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
