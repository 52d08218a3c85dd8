"""Connected components of links that may be many, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyledger.session import landed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node (large: those above it; small: those below and itself) to the least of them."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).union(
            joined.select("a", F.col("root").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b"))


def _is_starred(links: DataFrame) -> bool:
    """Whether every node has one link at most towards a lesser one, and none if others link to it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    counted = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return counted.where(F.col("below") + F.col("above") > 1).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links`` (``a``, ``b``).

    Self-links and repeated links are allowed; ``links`` is read several times, so it should be stored. Each round lands, so a lost executor costs one round at most. The rounds
    end when each component is a star around its least node, which another round would leave as it is.
    """
    now = links.select("a", "b").where("a <> b")
    now = landed(_star(_star(now, True), False).distinct(), "links")
    while not _is_starred(now):
        now = landed(_star(_star(now, True), False).distinct(), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (``node``, ``root``) once ``links`` have joined some components; ends without a root are nodes of their own.

    Only the roots that links join go through rounds, so the cost follows the new links.
    """
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    raised = components(landed(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "ends"))
    moves = raised.select(F.col("node").alias("root"), F.col("root").alias("__root"))
    moved = roots.join(moves, "root", "left").select("node", F.coalesce("__root", "root").alias("root"))
    return moved.union(raised.join(roots.select("node"), "node", "left_anti").select("node", "root"))
