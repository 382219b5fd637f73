"""Document quality by a classifier and hierarchical empirical Bayes over sites.

A logistic classifier on the shape of a text gives its evidence.  The mean evidence
of a host is shrunk toward that of all documents, and that of a path toward its
host's, by as much as the spread between hosts (paths) tells that they differ: a
site of few documents hardly moves from its prior.  The posterior of a document's
path, taken without the document itself, is the prior its own evidence is added to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlift.llm.common import packed, read_table, sampled, text_or_empty, unpacked, written
from feedlift.llm.logistic import fit_logistic

# Labelled documents that the classifier is fitted on, at most.
MOST_FITTED = 20_000
# Documents below this posterior are rejected.
LEAST_SCORE = 0.5
# Sites whose table may be handed to every task: far under the memory of one.
MOST_SITES = 50_000
# How many documents a prior is worth, at least and at most.
STRENGTHS = (4.0, 1e6)


def _kept(text: str, unlike: str) -> Column:
    """Characters of ``text`` that are not among ``unlike``, a class of a regular expression."""
    return F.char_length(F.regexp_replace(text, unlike, ""))


def features(text: str) -> dict[str, Column]:
    """Shares and counts over a whole text that tell prose from junk."""
    n = F.greatest(F.char_length(text), F.lit(1))
    words = F.size("_words")
    again = F.expr("zip_with(_words, slice(_words, 2, size(_words)), (a, b) -> a = b)")
    symbols = _kept(text, r"[\p{L}\p{N}\s.,;:'\"?()-]+") / n
    return {
        "symbols": F.sqrt(symbols),
        "any_symbols": F.least(symbols * 20, F.lit(1.0)),
        "capitals": F.sqrt(_kept(text, r"[^\p{Lu}]+") / n),
        "digits": F.sqrt(_kept(text, r"[^\p{N}]+") / n),
        "lines": F.sqrt((n - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))) / n),
        "distinct": F.size(F.array_distinct("_words")) / F.greatest(words, F.lit(1)),
        "repeated": F.sqrt(F.size(F.filter(again, lambda x: x)) / F.greatest(words, F.lit(1))),
        "word_length": F.least(F.log1p(n / F.greatest(words, F.lit(1))), F.lit(4.0)),
        "words": F.log1p(words.cast("double")),
    }


def with_features(docs: DataFrame) -> DataFrame:
    """Adds ``_x``, the features as an array, and ``_has_words``."""
    rows = docs.withColumn("_text", text_or_empty())
    words = F.array_remove(F.split("_text", r"\s+"), "")
    rows = rows.select("*", F.explode(F.array(words)).alias("_words"))
    named = features("_text")
    rows = rows.withColumn("_x", F.array(*(c.cast("double") for c in named.values())))
    return rows.withColumn("_has_words", F.size("_words") > 0).drop("_text", "_words")


@dataclass
class Classifier:
    """Logistic weights of the features."""

    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for number, weight in enumerate(self.weights):
            total = total + F.col("_x")[number] * weight
        return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FITTED) -> Classifier:
    """A classifier from ``most`` labelled documents at most, chosen by a hash of the id."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = named.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("_y"))
    chosen = sampled(marks, most, marks.count(), "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # A label that has its texts in several rows counts for each; ids make the order fixed.
    # Where an id is in so many rows that not all can be taken, a hash says which.
    order = F.xxhash64("doc_id", "_x")
    got = with_features(rows).where("_has_words").select("doc_id", "_x", "_y")
    got = got.orderBy(order, "doc_id", "_x").limit(2 * most)
    got = sorted(got.collect(), key=lambda row: (row["doc_id"], row["_x"]))
    size = len(features("_text"))
    x = np.array([row["_x"] for row in got], float).reshape(len(got), size)
    y = np.array([row["_y"] >= 0.5 for row in got], float)
    return Classifier(*fit_logistic(x, y))


def _strength(rates: DataFrame, prior: Column) -> float:
    """How many documents the prior is worth, by the moments of the rates around it.

    ``rates`` has ``n`` and ``s``, documents and sum of evidence of each site.
    """
    rate = F.col("s") / F.col("n")
    found = rates.agg(
        F.sum(F.col("n") * F.pow(rate - prior, 2)).alias("between"),
        F.sum(prior * (1 - prior)).alias("within"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("scale"),
        F.sum("n").alias("n"),
    ).first()
    if not found["n"]:
        return STRENGTHS[1]
    spread = (found["between"] - found["within"]) / found["n"]
    if spread <= 0:
        return STRENGTHS[1]
    return float(min(max(found["scale"] / found["n"] / spread - 1, STRENGTHS[0]), STRENGTHS[1]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass
class Sites:
    """Sums of evidence by path, and what is needed to shrink them."""

    paths: DataFrame
    rate: float
    host_strength: float
    path_strength: float
    few: bool


def sum_sites(evidence: DataFrame) -> Sites:
    """``evidence`` has ``_host``, ``_path`` and ``_p`` for each document."""
    by_path = evidence.groupBy("_host", "_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s")
    )
    by_path = written(by_path, "op9-paths")
    count = F.count(F.lit(1)).alias("k")
    total = by_path.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), count).first()
    rate = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    hosts = by_path.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    host_strength = _strength(hosts, F.lit(rate))
    hosts = hosts.select(
        F.col("_host").alias("_h"),
        F.col("n").alias("_host_n"),
        F.col("s").alias("_host_s"),
        ((rate * host_strength + F.col("s")) / (host_strength + F.col("n"))).alias("_host_rate"),
    )
    paths = by_path.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    path_strength = _strength(paths, F.col("_host_rate"))
    paths = paths.withColumnsRenamed(
        {"n": "_path_n", "s": "_path_s", "_host": "_site_host", "_path": "_site_path"}
    ).drop("_host_rate")
    return Sites(paths, rate, host_strength, path_strength, total["k"] <= MOST_SITES)


def with_posterior(evidence: DataFrame, sites: Sites) -> DataFrame:
    """Adds ``_host_rate`` and ``_path_rate``, each without the document itself, and ``_score``."""
    paths = F.broadcast(sites.paths) if sites.few else sites.paths
    met = F.col("_host").eqNullSafe(F.col("_site_host"))
    met = met & F.col("_path").eqNullSafe(F.col("_site_path"))
    rows = evidence.join(paths, met)
    host_n, host_s = F.col("_host_n") - 1, F.col("_host_s") - F.col("_p")
    path_n, path_s = F.col("_path_n") - 1, F.col("_path_s") - F.col("_p")
    host_rate = (sites.rate * sites.host_strength + host_s) / (sites.host_strength + host_n)
    rows = rows.withColumn("_host_rate", host_rate)
    strength = sites.path_strength
    path_rate = (F.col("_host_rate") * strength + path_s) / (strength + path_n)
    path_rate = F.greatest(F.least(path_rate, F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = rows.withColumn("_path_rate", path_rate)
    rate = math.log(sites.rate / (1 - sites.rate))
    posterior = F.col("_logit") + _logit(F.col("_path_rate")) - rate
    score = F.when(F.col("_has_words"), 1 / (1 + F.exp(-posterior))).otherwise(0.0)
    return rows.withColumn("_score", score).drop(*sites.paths.columns)


def score(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    most: int = MOST_FITTED,
) -> DataFrame:
    """``docs`` with ``_logit``, ``_p``, ``_host_rate``, ``_path_rate``, ``_score`` and ``_keep``.

    ``host`` and ``path`` say which site a document is of; by default its ``source``,
    and its ``source`` and ``lang``.  NULL is a site like any other.  A text without a
    word (null and empty ones) has the score 0.  Rows are scored each for itself,
    repeated ones alike; labels without an id or value are passed over, several of
    one id averaged.  Other columns stay; names that begin with ``_`` are this function's own.

    Two passes: one sums the evidence by site, the other scores.  Where there are
    many sites their sums are joined by a shuffle, else they go to the tasks.
    """
    model = train(docs, labels, most)
    host = F.col("source") if host is None else host
    path = F.struct("source", "lang") if path is None else path
    rows = with_features(docs.withColumns({"_host": host, "_path": F.xxhash64(path)}))
    rows = rows.withColumn("_logit", model.logit()).drop("_x")
    # Behind a generator, so that neither of the later uses computes the features again.
    rows = rows.select("*", F.explode(F.array(1 / (1 + F.exp(-F.col("_logit"))))).alias("_p"))
    sites = sum_sites(rows.select("_host", "_path", "_p"))
    scored = with_posterior(rows, sites)
    keep = (F.col("_score") >= LEAST_SCORE).cast("int")
    return scored.withColumn("_keep", keep).drop("_host", "_path", "_has_words")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that are rejected; columns may have any name and are as they were."""
    needed = ("doc_id", "text", "source", "lang")
    scored = score(packed(docs, *needed), read_table(spark, sf_dir, "labels"))
    return unpacked(scored.where("_keep = 1"), docs.columns, *needed)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.col("_p").alias("evidence"),
        F.col("_host_rate").alias("host_rate"),
        F.col("_path_rate").alias("path_rate"),
        F.col("_score").alias("score"),
        F.col("_keep").alias("keep"),
    )
