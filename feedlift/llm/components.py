"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlift.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select("u", "v").unionByName(back)


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the least node among its ``u`` and that node's neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the least of its neighbourhood."""
    starred = _with_least(_both_ways(edges)).where(F.col("v") > F.col("u"))
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the least of those."""
    down = edges.where(F.col("u") > F.col("v"))
    starred = _with_least(down)
    rest = starred.where(F.col("v") != F.col("m"))
    hung = rest.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(starred.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node but the roots.

    ``edges`` has two columns ``u`` and ``v`` of one orderable type without
    NULLs.  Alternating star rounds, some log(n) of them; each is a few joins and
    aggregations over the edges and is written to the shared folder.  What comes
    to the driver is one row per round: a count and a checksum.
    """
    now = written(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)).distinct(), "edges")
        check = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if check == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = check
    raise RuntimeError(f"components did not settle in {rounds} rounds")
