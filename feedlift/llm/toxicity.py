"""Toxic documents by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the windows in
which toxic texts stand out from ordinary ones.  A window of a document is compressed
with the ordinary dictionary alone and with both; the bytes that the toxic one
saves are the window's evidence.  As the ordinary part is the same, ordinary words
cost the same either way and do not blur the difference.  A document's windows
give it a score that is calibrated on labelled documents the dictionaries have
not seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.llm.common import crc_of_id, map_slices, read_table, sampled
from feedlift.llm.logistic import fit_logistic

WINDOW = 8
LEVEL, LEAST_MATCH = 12, 4
# Labelled documents that the model is fitted on, at most, and the longest of them.
MOST_TOXIC, MOST_ORDINARY = 2_500, 5_000
LONGEST_FITTED = 20_000
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 16_384
# Parts of words, by which words of one stem are found to stand out together.
GRAM = 5
# How far one must stand out, as a log likelihood ratio, beyond what chance gives the best
# of all that are looked at.
BEYOND_CHANCE = 8.0
# And how much likelier it must be in a toxic document than in an ordinary one.
LEAST_ODDS = 3.0
TOXIC_FROM = 0.3


def _windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [
        (" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)
    ]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=64,
        dict_size=len(content),
        min_match=LEAST_MATCH,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=parameters)
    given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=given, compression_params=parameters)


def train_dictionary(samples: list[bytes], most: int) -> bytes:
    """A dictionary's content; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-most:]


@dataclass
class Model:
    """Two dictionaries, and what turns the bytes saved into a score."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    intercept: float

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}  # compressors are made where they are used

    def measures(self, text: str | None) -> list[float]:
        """The largest saving, savings beyond chance, their share, and the length."""
        if self._pair is None:
            # The ordinary content stands last in both, at equal distances from the window.
            self._pair = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        plain, both = (c.compress for c in self._pair)
        saved = [len(plain(w)) - len(both(w)) for w in _windows(text or "")]
        if not saved:
            return [0.0] * 4
        large = [s for s in saved if s >= 2]
        share = math.sqrt(len(large) / len(saved))
        return [min(max(saved), 12), math.log1p(sum(large)), share, math.log(len(saved))]

    def score(self, text: str | None) -> float:
        total = sum(w * x for w, x in zip(self.weights, self.measures(text), strict=True))
        return 1 / (1 + math.exp(-min(max(total + self.intercept, -30.0), 30.0)))


def _ratio(of_toxic: int, of_ordinary: int, toxic: int, ordinary: int) -> float:
    """Log likelihood ratio of being in more toxic documents than by chance; 0 if in fewer."""
    n = of_toxic + of_ordinary
    share = toxic / (toxic + ordinary)
    if of_toxic <= n * share:
        return 0.0
    ratio = of_toxic * math.log(of_toxic / (n * share))
    if of_ordinary:
        ratio += of_ordinary * math.log(of_ordinary / (n * (1 - share)))
    return 2 * ratio


def _odds(of_toxic: int, of_ordinary: int, toxic: int, ordinary: int) -> float:
    return (of_toxic + 0.5) / (toxic + 1) / ((of_ordinary + 0.5) / (ordinary + 1))


def _grams(words: set[str]) -> set[str]:
    padded = [f" {word} " for word in words]
    return {word[i : i + GRAM] for word in padded for i in range(max(1, len(word) - GRAM + 1))}


def _apart(rows: list[tuple[str, int]]) -> list[tuple[set[str], int]]:
    """Words and mark of each text, most copies left out: they would pass for evidence.

    Near copies mostly share the three words in a row whose hash is the least.
    """
    found = {}
    for text, mark in rows:
        words = text.lower().split()
        runs = zip(words, words[1:], words[2:], strict=False)
        least = min((zlib.crc32(" ".join(run).encode()) for run in runs), default=text)
        found.setdefault((least, mark), (set(words), mark))
    return list(found.values())


def _standing(words: list[tuple[set[str], int]]) -> set[str]:
    """Words that have a part by which toxic documents stand out, and do so themselves."""
    toxic = sum(mark for _, mark in words)
    totals = toxic, len(words) - toxic
    parts = Counter(gram for own, mark in words if mark for gram in _grams(own))
    parts = Counter({gram: n for gram, n in parts.items() if n > 1})
    others: Counter[str] = Counter()
    for own, mark in words:
        if not mark:
            others.update(_grams(own) & parts.keys())
    least = BEYOND_CHANCE + 2 * math.log(max(1, len(parts)))
    likelier = {g for g, n in parts.items() if _odds(n, others[g], *totals) >= LEAST_ODDS}
    chosen = {g for g in likelier if _ratio(parts[g], others[g], *totals) >= least}
    found = Counter(w for own, mark in words if mark for w in own if _grams({w}) & chosen)
    others = Counter(w for own, mark in words if not mark for w in own & found.keys())
    return {w for w, n in found.items() if _odds(n, others[w], *totals) > 1}


def _dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and that of the words by which toxic texts stand out."""
    standing = _standing(_apart(rows))
    marked, plain = [], []
    for text, mark in rows:
        if mark:
            marked += [f" {word} ".encode() for word in text.lower().split() if word in standing]
        else:
            plain += _windows(text)
    plain = plain[:: max(1, len(plain) // 60_000)]
    toxic = train_dictionary(marked, TOXIC_BYTES) if marked else b""
    return train_dictionary(plain, ORDINARY_BYTES), toxic


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from texts and marks.

    Dictionaries of one half of them are calibrated on the other; then they are trained
    on all.  Without examples of both kinds the score is the share of toxic ones.
    """
    learned, held = rows[::2], rows[1::2]
    if any(len({mark for _, mark in part}) < 2 for part in (learned, held)):
        share = (sum(mark for _, mark in rows) + 0.5) / (len(rows) + 2)
        return Model(b"", b"", [0.0] * 4, math.log(share / (1 - share)))
    model = Model(*_dictionaries(learned), [0.0] * 4, 0.0)
    x = np.array([model.measures(text) for text, _ in held], float).reshape(-1, 4)
    weights, intercept = fit_logistic(x, np.array([mark for _, mark in held], float))
    return Model(*_dictionaries(rows), weights, intercept)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` that ``labels`` marks; other documents and null marks are passed over.

    At most ``MOST_TOXIC`` and ``MOST_ORDINARY`` documents come to the driver, chosen by
    a hash of the id, none longer than ``LONGEST_FITTED``; that bounds the sample.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_mark"))
    sizes = {row["_mark"]: row["count"] for row in marks.groupBy("_mark").count().collect()}
    chosen = None
    for mark, most in ((0, MOST_ORDINARY), (1, MOST_TOXIC)):
        part = sampled(marks.where(F.col("_mark") == mark), most, sizes.get(mark, 0), "doc_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.where(F.char_length("text") <= LONGEST_FITTED).select("doc_id", "text")
    # A sample of bounded size.
    got = rows.join(F.broadcast(chosen), "doc_id").limit(2 * (MOST_TOXIC + MOST_ORDINARY)).collect()
    got.sort(key=lambda row: (zlib.crc32(str(row["doc_id"]).encode()), row["doc_id"], row["text"]))
    return fit([(row["text"], row["_mark"]) for row in got])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for every row of ``docs``, by its text alone.

    Null and empty texts have no windows and score what the calibration gives to
    that.  Repeated rows get equal results.
    """

    def score(rows: list[dict]) -> pa.RecordBatch:
        arrays = [
            pa.array([row["doc_id"] for row in rows], pa.int64()),
            pa.array([model.score(row["text"]) for row in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "score"])

    return map_slices(docs.select("doc_id", "text"), score, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").where(~held_out)
    scored = classify(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )
