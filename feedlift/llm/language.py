"""Languages by rank-order profiles of character n-grams.

The most frequent n-grams of a language, ranked, are its profile.  A document is
ranked likewise, and its distance from a profile is how far its n-grams are out of
place there, those that the profile lacks by a whole profile's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedlift.llm.common import crc_of_id, map_slices, read_table, written

# N-grams of a profile and of a document that are ranked.
RANKS = 300
# Documents of a language that its profile is learned from, at most.
MOST_LEARNED = 3_000
# Languages whose sizes may be handed to every task.
MOST_LANGUAGES = 10_000
# How fast trust falls with distance, in shares of the largest distance.
SHARPNESS = 40.0
UNKNOWN = "und"
_BITS = 21

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text's words, with their borders."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    points = np.where(_is_letter()[points], points, 0)
    points = np.concatenate([[0], points, [0]])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    one = points[points != 0]
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = points[:-1] << _BITS | points[1:] | 1 << 62
    three = (points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:])[points[1:-1] != 0]
    return np.unique(np.concatenate([one, two, three | 1 << 61]), return_counts=True)


def ranked(codes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The most frequent codes, the most frequent first, of equal ones the smaller."""
    return codes[np.lexsort((codes, -found))[:RANKS]]


class Profiles:
    """The ranks of all languages' n-grams, as one table."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.languages = sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for number, language in enumerate(self.languages):
            at = np.searchsorted(self.codes, np.array(profiles[language], np.int64))
            self.ranks[at, number] = np.arange(len(at))

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Out-of-place distances of ranked codes from each language, as shares of the largest."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        apart = np.abs(ranks - np.arange(len(codes))[:, None])
        return np.where(ranks < 0, RANKS, apart).sum(axis=0) / (RANKS * max(1, len(codes)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, of equally near ones the first by name, and the trust in it."""
        codes, found = counts(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        apart = self.distances(ranked(codes, found))
        trust = np.exp(-SHARPNESS * (apart - apart.min()))
        best = int(np.argmin(apart))
        return self.languages[best], float(trust[best] / trust.sum())


def learn(rows: DataFrame, most: int = MOST_LEARNED) -> Profiles:
    """Profiles from ``text`` and ``lang``; rows without either are passed over.

    Of each language about ``most`` rows are taken, by a hash of the text.  Their
    n-grams are counted where they are and summed; what comes to the driver is
    each language's profile.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_size"))
    sizes = written(sizes, "op4-sizes")
    # One row for each language: without the hint, texts would be dealt out by language.
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_LANGUAGES else sizes
    share = F.lit(1_000_000 * most) / F.col("_size")
    taken = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)

    def count(part: list[dict]) -> pa.RecordBatch:
        languages, codes, found = [], [], []
        for row in part:
            own, times = counts(row["text"])
            languages += [row["lang"]] * len(own)
            codes.append(own)
            found.append(times)
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (codes, found)]
        arrays = [pa.array(languages, pa.string()), *(pa.array(x) for x in columns)]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "code", "n"])

    each = map_slices(taken.select("lang", "text"), count, "lang string, code long, n long")
    summed = each.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    top = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "rank", "code").collect():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return Profiles({k: [code for _, code in sorted(v)] for k, v in profiles.items()})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row of ``docs``, from its text alone.

    A null text and one without a letter are ``und`` with score 0, as is every text
    where no language was learned.  Repeated rows get equal results.
    """

    def predict(rows: list[dict]) -> pa.RecordBatch:
        found = [profiles.predict(row["text"]) for row in rows]
        arrays = [
            pa.array([row["doc_id"] for row in rows], pa.int64()),
            pa.array([language for language, _ in found], pa.string()),
            pa.array([score for _, score in found], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    schema = "doc_id long, lang_pred string, score double"
    return map_slices(docs.select("doc_id", "text"), predict, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    profiles = learn(docs.where(~held_out))
    found = identify(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
