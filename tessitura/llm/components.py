"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, name: str = "cc") -> DataFrame:
    """node, root for every node of ``links`` (a, b: long): ``root`` is the smallest node reachable.

    Alternates two star steps until nothing changes: every larger neighbour is
    hung on the smallest one known (large star), then every node's smaller
    neighbours on the smallest of them (small star).  Minima are aggregated
    before they are shuffled, each round's links are written to the shared
    folder, and only three totals of a round reach the driver.
    """
    links = materialize(_canonical(links), f"{name}-links")
    state = _totals(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(_canonical(large), f"{name}-large")  # a is the larger end
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(_canonical(small.unionByName(least.select("a", F.col("m").alias("b")))), f"{name}-small")
        after = _totals(links)
        if after == state:
            break
        state = after
    roots = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(links.select(F.col("b").alias("node")).distinct().join(links.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root")))


def _canonical(links: DataFrame) -> DataFrame:
    """Distinct links without loops, larger end first."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _totals(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0))).first())
