"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, written


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), 2 * total)
    return by_key(both, least, ["a"], "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), total)
    moved = by_key(down, least, ["a"], "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _stars(links: DataFrame) -> bool:
    """Whether every ``b`` has one ``a``, less than it, that is no ``b``."""
    ends = links.select(F.col("b").alias("x"), F.lit(1).alias("down"), (F.col("a") > F.col("b")).cast("int").alias("up")).unionByName(links.select(F.col("a").alias("x"), F.lit(0).alias("down"), F.lit(0).alias("up")))
    each = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"))
    return not each.where("down > 0 and (down < n or down > 1 or up > 0)").take(1)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``a, b`` links to ``node, component`` (the least node reachable), for nodes that have a link.

    Each round is written to the shared folder; rounds grow with the logarithm
    of the longest path, and end when every component is a star around its
    least node. Links of a node to itself and repeated links change nothing.
    ``links`` should be a written table, as it is counted first; no table of a
    round has more than twice its rows.
    """
    total = links.count()
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), total)
    for _ in range(rounds):
        if _stars(links):
            break
        total = links.count()
        large = written(_large_star(links, total).distinct(), total)
        total = large.count()
        links = written(_small_star(large, total).select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), 2 * total)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
