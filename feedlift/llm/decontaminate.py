"""Benchmark items in documents, also with other numbers, names and units.

Texts become templates: a number, a name (a capitalised word inside a sentence)
and a unit (after a number) become a placeholder of its type.  Windows of template
words are joined by hash with those of the benchmark.  Where they meet, item and
passage are aligned and held against each other: the words must agree, and the
values of the item must mostly have become the same value wherever they stand.
An item without such a window, being short or nearly all values, is found where its
words and values stand one after another as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlift.llm.common import map_slices, packed, read_table, row_hash, unpacked, written

WINDOW = 6
# Words of a window that must not be placeholders.
LEAST_LITERAL = 3
# Share of an item's words that a passage must have, in runs of at least so many.
LEAST_COVERED = 0.6
LEAST_RUN = 4
# From this share of words on, values need not be replaced one by one: some of the places
# of a value may go their own way, and different values may become equal.
NEARLY_ALL = 0.8
# One in so many places of values, or one at least, may go its own way.
OWN_WAY = 6
# Words by which parts of one copy may have moved against each other.
MOST_SHIFT = 8
# Benchmarks of up to so many windows are known to the tasks that read documents, which
# then drop windows that cannot meet one.  Beyond, every window goes into the join.
MOST_KNOWN = 1_000_000
# Units after a number; fixed values.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons ms s sec min "
    "h second seconds minute minutes hour hours day days week weeks month months year years mph "
    "kmh dollar dollars cent cents euro euros percent degree degrees".split()
)

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]+")


def _class(pattern: str) -> str:
    """The characters of up to two bytes that match, as ranges: one table for the matcher."""
    runs = re.findall(f"{pattern}+", "".join(map(chr, range(1 << 16))))
    return "".join(f"{run[0]}-{run[-1]}" for run in runs)


# The same for texts without characters beyond these, by tables of them.
_DIGITS = _class(r"\d")
_SHORT_TOKEN = re.compile(rf"[{_class(r'[^\W\d_]')}]+|[{_DIGITS}]+(?:[.,][{_DIGITS}]+)*|[.!?\n]+")
_WORD, _NAME, _UNIT, _NUMBER, _END = range(5)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Token to a number: a hash of its lower case over its kind in the lowest three bits."""

    MOST = 400_000

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first in ".!?\n":
            kind = _END
        elif first.isdigit():
            kind = _NUMBER
        elif token.lower() in UNITS:
            kind = _UNIT
        else:
            kind = _NAME if first.isupper() else _WORD
        code = xxhash.xxh64_intdigest(token.lower()) & ~7 | kind
        if len(self) >= self.MOST:
            self.clear()
        self[token] = code
        return code


_CODES = _Codes()
_PLACEHOLDERS = np.array([0, *(xxhash.xxh64_intdigest(str(k)) for k in (1, 2, 3))], np.uint64)


def tokens_of(text: str) -> list[str]:
    """Words, numbers, and ends of sentences."""
    short = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return (_SHORT_TOKEN if short else _TOKEN).findall(text)


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, of its template, and which token each word is.

    In the first only numbers and units are replaced, in the second names too: a
    copy in capitals has no names, one with other names no equal words.
    """
    return forms(text)[:3]


def forms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`template`, and hashes of words and values as they are, but for capitals."""
    tokens = tokens_of(text)
    codes = np.fromiter(map(_CODES.__getitem__, tokens), np.uint64, len(tokens))
    kinds = (codes & np.uint64(7)).astype(np.int8)
    before = np.concatenate([np.array([_END], np.int8), kinds])[:-1]
    kinds = np.where((kinds == _NAME) & (before == _END), _WORD, kinds)
    kinds = np.where((kinds == _UNIT) & (before != _NUMBER), _WORD, kinds)
    at = np.nonzero(kinds != _END)[0]
    codes, kinds = codes[at] & ~np.uint64(7), kinds[at]
    typed = np.where(kinds == _WORD, codes, _PLACEHOLDERS[np.minimum(kinds, _NUMBER)])
    plain = np.where(kinds == _NAME, codes, typed)
    return plain, typed, at, codes


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash at every place where a window begins; 0 where it is nearly all placeholders."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return _hashes([words[step : step + n] for step in range(WINDOW)])


def _hashes(steps: list[np.ndarray]) -> np.ndarray:
    """Hashes of windows, given as their first words, their second words and so on."""
    total = _mixed(steps)
    total[~_mostly_words(steps)] = 0
    return total


def _mixed(steps: list[np.ndarray]) -> np.ndarray:
    """Hashes of windows, also of those that are nearly all placeholders."""
    total = np.zeros(len(steps[0]), np.uint64)
    for step, part in enumerate(steps):
        total ^= part + np.uint64(step)
        total *= _FACTOR
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def _mostly_words(steps: list[np.ndarray]) -> np.ndarray:
    """Which windows have ``LEAST_LITERAL`` words that are no placeholders."""
    typed = np.zeros(len(steps[0]), np.int8)
    for part in steps:
        for placeholder in _PLACEHOLDERS[1:]:
            typed += part == placeholder
    return typed <= WINDOW - LEAST_LITERAL


def typed_begins(plain: np.ndarray, typed: np.ndarray) -> np.ndarray:
    """Where windows with a name begin; the hashes of others are those of ``plain``."""
    n = len(plain) - WINDOW + 1
    names = np.nonzero(plain != typed)[0]
    if n <= 0 or not len(names):
        return names[:0]
    changed = np.zeros(n + 2 * WINDOW, bool)
    for step in range(WINDOW):
        changed[names + step] = True
    # What was marked at a word is where a window that ends there begins, shifted by its words.
    return np.nonzero(changed[WINDOW - 1 : WINDOW - 1 + n])[0]


def typed_hashes(plain: np.ndarray, typed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows with a name begin, and their hashes; the others are those of ``plain``."""
    begins = typed_begins(plain, typed)
    return begins, _hashes([typed[begins + step] for step in range(WINDOW)])


def raw_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash at every place where ``length`` words begin, in log(length) steps."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    # By doubling: the hash of 2k words is that of k and of the k after them.
    part, size, done = words, 1, 0
    while True:
        if length & size:
            total = (total ^ (part[done : done + n] + np.uint64(size))) * _FACTOR
            total ^= total >> np.uint64(29)
            done += size
        if done == length:
            break
        later = part[size:]
        part = (part[: len(later)] * _FACTOR) ^ (later + np.uint64(size))
        part = (part ^ (part >> np.uint64(31))) * _FACTOR
        size *= 2
    total ^= np.uint64(length)
    total = (total ^ (total >> np.uint64(31))) * _FACTOR
    total ^= total >> np.uint64(29)
    total[total == 0] = 1
    return total.view(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id`` and ``hash`` for each window of each item, in both forms.

    ``words`` is how many the item has.  An item without a window has the hash of
    all its words, and their number as ``length``, which is 0 for windows.
    """

    def windows(rows: list[dict]) -> pa.RecordBatch:
        ids, hashes, lengths, words = [], [], [], []
        for row in rows:
            plain, typed, _, raw = forms(row["text"] or "")
            both = np.union1d(window_hashes(plain), window_hashes(typed))
            both, length = both[both != 0], 0
            if not len(both) and len(plain):
                length = len(plain)
                both = raw_hashes(raw, length)
            ids.append(np.full(len(both), row["item_id"], np.int64))
            hashes.append(both)
            lengths.append(np.full(len(both), length, np.int64))
            words.append(np.full(len(both), len(plain), np.int64))
        columns = [
            pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
            for x in (ids, hashes, lengths, words)
        ]
        return pa.RecordBatch.from_arrays(columns, ["item_id", "hash", "length", "words"])

    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    return map_slices(rows.distinct(), windows, "item_id long, hash long, length long, words long")


def _known(windows: DataFrame) -> np.ndarray | None:
    """The benchmark's hashes, if there are not too many of them to hand to every task."""
    distinct = windows.select("hash").distinct()
    if distinct.count() > MOST_KNOWN:
        return None
    return np.sort(distinct.toArrow()["hash"].to_numpy())


def passages(
    docs: DataFrame, known: np.ndarray | None, margin: int, lengths: list[int]
) -> DataFrame:
    """Places of documents that may hold a part of an item, with ``margin`` words around.

    ``hashes`` has the windows there, and those of words as they are of each of
    ``lengths``.  Without ``known`` the place is the whole text.
    """
    if known is not None:
        flags = np.zeros(1 << 20, bool)
        flags[known & ((1 << 20) - 1)] = True

    def met(hashes: np.ndarray) -> np.ndarray:
        """Which hashes are an item's; 0 is never one."""
        if known is None:
            return np.nonzero(hashes)[0]
        if not len(known):
            return np.zeros(0, np.int64)
        some = np.nonzero(flags[hashes & ((1 << 20) - 1)])[0]
        at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        return some[known[at] == hashes[some]]

    def windows(words: np.ndarray, begins: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Where an item's windows begin, of those at ``begins`` or of all, and their hashes."""
        n, none = len(words) - WINDOW + 1, np.zeros(0, np.int64)
        if n <= 0 or (begins is not None and not len(begins)):
            return none, none
        steps = [
            words[step : step + n] if begins is None else words[begins + step]
            for step in range(WINDOW)
        ]
        hashes = _mixed(steps)
        hit = np.arange(len(hashes)) if known is None else met(hashes)
        if not len(hit):
            return none, none
        # Placeholders are counted where a window meets an item, which few do.
        hit = hit[_mostly_words([part[hit] for part in steps])]
        hit = hit[hashes[hit] != 0]
        return (hit if begins is None else begins[hit]), hashes[hit]

    def copies(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = raw_hashes(words, length)
        hit = met(hashes)
        return hit, hashes[hit]

    def cut(rows: list[dict]) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "text_key": [], "place": [], "hashes": [], "part": []}
        for row in rows:
            plain, typed, at, raw = forms(row["text"])
            # Where hits begin, their hashes and their last words.
            begins, found, lasts = [], [], []
            for (places, hashes), length in (
                (windows(plain, None), WINDOW),
                (windows(typed, typed_begins(plain, typed)), WINDOW),
                *((copies(raw, length), length) for length in lengths),
            ):
                begins.append(places)
                found.append(hashes)
                lasts.append(places + length - 1)
            begins, found, lasts = map(np.concatenate, (begins, found, lasts))
            if not len(begins):
                continue
            order = np.argsort(begins, kind="stable")
            begins, found, lasts = begins[order], found[order], lasts[order]
            reached = np.maximum.accumulate(lasts)
            gaps = np.nonzero(begins[1:] - reached[:-1] > margin)[0] + 1
            everything = np.arange(len(begins))
            ends = None
            runs = np.split(everything, gaps) if known is not None else [everything]
            for number, run in enumerate(runs):
                hashes = np.unique(found[run])
                part = row["text"]
                if known is not None:
                    if ends is None:
                        ends = [match.span() for match in _TOKEN.finditer(row["text"])]
                    first = max(0, begins[run[0]] - margin)
                    last = min(len(at) - 1, reached[run[-1]] + margin)
                    part = part[ends[at[first]][0] : ends[at[last]][1]]
                for name, value in zip(
                    out, (row["doc_id"], row["text_key"], number, hashes, part), strict=True
                ):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
        columns = [pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, list(out))

    rows = docs.where("text <> ''").select("doc_id", "text", row_hash().alias("text_key"))
    schema = "doc_id long, text_key long, place long, hashes array<long>, part string"
    return map_slices(rows, cut, schema)


def _diagonals(item: list[np.ndarray], part: list[np.ndarray]) -> list[int]:
    """Diagonals around which windows of the item meet the passage, fullest first.

    One stands for all within ``MOST_SHIFT`` words of it; each is a place of its own.
    """
    votes: Counter[int] = Counter()
    for one, two in zip(item, part, strict=True):
        at: dict[int, list[int]] = {}
        for i, code in enumerate(window_hashes(one).tolist()):
            if code:
                at.setdefault(code, []).append(i)
        hashes = window_hashes(two)
        for j in np.nonzero(np.isin(hashes, np.array(list(at), np.int64)))[0].tolist():
            for i in at[int(hashes[j])]:
                votes[j - i] += 1
    out = []
    # A diagonal goes with a fuller one nearby: neighbours are looked up, not searched.
    taken: set[int] = set()
    for diagonal, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
        if diagonal not in taken:
            out.append(diagonal)
            taken.update(range(diagonal - MOST_SHIFT, diagonal + MOST_SHIFT + 1))
    return out


def _aligned(item: np.ndarray, part: np.ndarray, diagonal: int) -> list[tuple[int, int, int]]:
    """Runs of equal words around ``diagonal``, none far off it."""
    first = max(0, diagonal - MOST_SHIFT)
    near = part[first : max(first, diagonal + len(item) + MOST_SHIFT)]
    blocks = SequenceMatcher(None, item.tolist(), near.tolist(), autojunk=False)
    least = min(LEAST_RUN, len(item))
    return [
        (b.a, b.b + first, b.size)
        for b in blocks.get_matching_blocks()
        if b.size >= least and abs(b.b + first - b.a - diagonal) <= MOST_SHIFT
    ]


def _kind(pairs: list[tuple[str, str]], covered: float, equal: float) -> str:
    """What the values became, given as pairs: ``copy``, ``template`` or ``slots``.

    ``covered`` is the share of words that agree as template, ``equal`` that of
    words and values that are the very same.
    """
    if all(a == b for a, b in pairs):
        return "copy"
    became: dict[str, Counter[str]] = {}
    for a, b in pairs:
        became.setdefault(a, Counter())[b] += 1
    own_way = len(pairs) - sum(max(x.values()) for x in became.values())
    if covered < NEARLY_ALL:
        one_to_one = not own_way and len({b for _, b in pairs}) == len(became)
        return "template" if one_to_one else "slots"
    few = own_way <= max(1, len(pairs) / OWN_WAY)
    return "template" if few or equal >= NEARLY_ALL else "slots"


def compare(item: str, part: str) -> tuple[float, str]:
    """Share of the item's words that the passage has, and how: ``copy`` or ``template``.

    Every place of the passage that has a window of the item is looked at by itself.
    ``slots`` where words agree but the item's values did not become others in a
    way that keeps the question.  Where nearly all words agree, that is: more than
    one in ``OWN_WAY`` of their places do not follow the rest, and they are not mostly
    as they were.  Where fewer agree: a value became several, or several one.
    """
    best = (0.0, "none")
    both = []
    for text in (item, part):
        plain, typed, at = template(text)
        tokens = _TOKEN.findall(text)
        both.append((plain, typed, [tokens[i].lower() for i in at]))
    (plain, typed, words), (plain_part, typed_part, words_part) = both
    if not words:
        return best
    if f" {' '.join(words)} " in f" {' '.join(words_part)} ":
        return (1.0, "copy")
    counts = ("copy", "template")
    for diagonal in _diagonals([plain, typed], [plain_part, typed_part]):
        # The fuller alignment of a place decides, of equal ones that which counts.
        here = (0.0, "none")
        for one, two in ((plain, plain_part), (typed, typed_part)):
            runs = _aligned(one, two, diagonal)
            covered = sum(run[2] for run in runs) / len(one)
            places = [(i + step, j + step) for i, j, size in runs for step in range(size)]
            equal = sum(words[i] == words_part[j] for i, j in places) / len(one)
            values = [(words[i], words_part[j]) for i, j in places if one[i] in _PLACEHOLDERS]
            found = (covered, _kind(values, covered, equal))
            here = max(here, found, key=lambda x: (x[0], x[1] in counts))
        # Of several places the fullest that counts as a leak, if there is one.
        best = max(best, here, key=lambda x: (x[0] >= LEAST_COVERED and x[1] in counts, x[0]))
    return best


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``item_id``, ``covered`` and ``kind``, once for each leak.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and
    ``text``; other columns are not looked at.  Null and empty texts leak nothing
    and nothing leaks from them, nor from items without an id or without a word or
    number.  Items without a window of ``WINDOW`` words leak where they are copied as
    they are.  Rows that share id and text are one document, a missing id is an id of
    its own, and rows of one item are forms of it.
    """
    windows = written(item_windows(items), "op2-windows")
    named = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    # As far as an alignment looks from any of its windows, and the word before: what is
    # around a place does not depend on whether the place is cut out.
    longest = windows.agg(F.max("words")).first()[0] or 0
    margin = longest + MOST_SHIFT + 1
    lengths = windows.where("length > 0").select("length").distinct().orderBy("length")
    lengths = [row["length"] for row in lengths.collect()]
    places = written(passages(docs, _known(windows), margin, lengths), "op2-places")
    place = ["doc_id", "text_key", "place"]
    hits = places.select(*place, F.explode("hashes").alias("hash"))
    hits = hits.join(windows.select("item_id", "hash"), "hash")
    votes = hits.select(*place, "item_id").distinct()
    votes = votes.withColumnsRenamed({name: f"v_{name}" for name in place})
    met = (
        places["doc_id"].eqNullSafe(votes["v_doc_id"])
        & (places["text_key"] == votes["v_text_key"])
        & (places["place"] == votes["v_place"])
    )
    named_by = ["doc_id", "text_key", "item_id"]
    pairs = places.select(*place, "part").join(votes, met).select(*named_by, "part")
    pairs = pairs.join(named.distinct().withColumnRenamed("text", "item"), "item_id")

    def verify(rows: list[dict]) -> pa.RecordBatch:
        found = [compare(row["item"], row["part"]) for row in rows]
        columns = [pa.array([row[name] for row in rows], pa.int64()) for name in named_by]
        columns += [
            pa.array([x[0] for x in found], pa.float64()),
            pa.array([x[1] for x in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [*named_by, "covered", "kind"])

    schema = "doc_id long, text_key long, item_id long, covered double, kind string"
    checked = map_slices(pairs, verify, schema)
    checked = checked.where((F.col("covered") >= LEAST_COVERED) & (F.col("kind") != "slots"))
    return checked.groupBy(*named_by).agg(
        F.max("covered").alias("covered"), F.min("kind").alias("kind")
    )


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns may have any name."""
    found = leaks(docs, read_table(spark, sf_dir, "benchmark"))
    found = found.selectExpr("doc_id AS leaked_id", "text_key AS leaked_key").distinct()
    keyed = packed(docs, "doc_id", "text", more=[row_hash().alias("text_key")])
    met = keyed["doc_id"].eqNullSafe(found["leaked_id"]) & (
        keyed["text_key"] == found["leaked_key"]
    )
    return unpacked(keyed.join(found, met, "left_anti"), docs.columns, "doc_id", "text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item it holds."""
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "kind").distinct()
