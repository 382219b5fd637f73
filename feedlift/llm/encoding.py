"""Token ids of whole texts by a public byte-level BPE, piece by piece."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

BYTE_BPE = "byte_bpe_50k.json"
# The vocabulary's own way to cut pre-tokens; a fixed value.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A blank with text on both sides always begins a pre-token: what stands before
# it and what begins with it are encoded apart without changing an id.
_PARTING = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
# Bytes that byte-level vocabularies write as the character of that number; the others
# are written as the characters from 256 on, in order.
_PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, int]:
    plain = {byte for part in _PLAIN_BYTES for byte in part}
    others = (byte for byte in range(256) if byte not in plain)
    return {byte: 256 + number for number, byte in enumerate(others)}


def parts_of(text: str) -> list[str]:
    """Texts between the blanks before which a pre-token always begins."""
    plain = (
        "  " not in text
        and " \n" not in text
        and "\n " not in text
        and text[:1] != " "
        and text[-1:] != " "
        and not _OTHER_SPACE.search(text)
    )
    return text.split(" ") if plain else _PARTING.split(text)


class Remembered(dict):
    """Values of short pieces of text that come again, twice ``most`` of them at most.

    When it is full, what was not asked for since it was last full is forgotten.
    """

    def __init__(self, value, most: int = 400_000, longest: int = 48) -> None:
        super().__init__()
        self._value, self._most, self._longest = value, most, longest
        self._before: dict = {}

    def __missing__(self, piece: str):
        got = self._before.get(piece)
        if got is None:
            got = self._value(piece)
        if len(piece) <= self._longest:
            if len(self) >= self._most:
                self._before = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Ids of texts and of single pre-tokens by one vocabulary."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        kind = str(self._tokenizer.pre_tokenizer)
        if self._tokenizer.normalizer or "ByteLevel(add_prefix_space=False" not in kind:
            raise ValueError(f"{path} is not a byte-level vocabulary without a normalizer")
        self._model = self._tokenizer.model
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._characters = _byte_characters()
        self._blank = chr(self._characters[ord(" ")])
        self.pieces = Remembered(self._piece, most)
        self._after_blanks = Remembered(self._after_blank, most)
        self._marks = {mark: self._piece(mark) for mark in ".,;:!?"}

    def _tokens(self, piece: str) -> list:
        if piece.isascii() and piece.isprintable():
            return self._model.tokenize(piece.replace(" ", self._blank))
        return self._model.tokenize(piece.encode().decode("latin-1").translate(self._characters))

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        return array("I", [token.id for token in self._tokens(piece)]).tobytes()

    def count(self, piece: str) -> int:
        """How many tokens a pre-token has."""
        return len(self._tokens(piece))

    def after_blank(self, part: str) -> bytes:
        """Ids of a blank and a part; strings of special tokens are ordinary text."""
        return self._after_blank(part)

    def token_bytes(self) -> list[bytes]:
        """What each id of the vocabulary stands for in a text; nothing for special tokens."""
        byte_of = {chr(char): byte for byte, char in self._characters.items()}
        byte_of |= {chr(byte): byte for part in _PLAIN_BYTES for byte in part}
        vocabulary = self._tokenizer.get_vocab()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if token not in self._specials:
                out[number] = bytes(map(byte_of.__getitem__, token))
        return out

    def _after_blank(self, part: str) -> bytes:
        """Ids of a blank and a part without blanks."""
        if part.isalpha():
            if not part.isascii():
                return self._piece(" " + part)
            tokens = self._model.tokenize(self._blank + part)
            return array("I", [token.id for token in tokens]).tobytes()
        # Most others are a word and a mark, which is a pre-token of its own.
        word, mark = part[:-1], part[-1]
        if mark in self._marks and word.isalpha():
            return self._after_blanks[word] + self._marks[mark]
        return b"".join(map(self.pieces.__getitem__, PRE_TOKEN.findall(" " + part)))

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if any(special in text for special in self._specials):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4")
        first, *rest = parts_of(text)
        ids = list(map(self.pieces.__getitem__, PRE_TOKEN.findall(first)))
        ids += map(self._after_blanks.__getitem__, rest)
        return np.frombuffer(b"".join(ids), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
