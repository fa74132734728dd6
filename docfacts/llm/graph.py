"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docfacts.llm.common import written

ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one around it."""
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. ``links`` run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node that has a link: columns ``node, component``.

    ``links`` has two columns of ids. Stars are contracted in turns until nothing changes; no round makes
    more rows than there are links, minima are taken before the shuffle, and each round's links
    are a table in the shared folder.
    """
    a, b = links.columns
    oriented = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    current = written(oriented, "links")
    sign = None
    for _ in range(ROUNDS):
        current = written(_small_star(_large_star(current).distinct()).distinct(), "links")
        now = current.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    tops = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
