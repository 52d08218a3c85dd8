"""Items to identities: canonical URLs, first occurrence per pull, and what is not held yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyledger.functions.urls import with_canonical_url
from storyledger.sizing import broadcast_if_small


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key, as a partial aggregate.

    Copies fold together before the shuffle, so a key that holds a third of all rows costs
    one row per task. A ranking window would send all of them to a single task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def identify(items: DataFrame, lowercase: Column | None = None) -> DataFrame:
    """Items with ``url``; items whose URL is unusable keep a null one, so they can be counted."""
    return with_canonical_url(items, "url_raw", out="url", lowercase=lowercase)


def dedup_within_pull(items: DataFrame) -> DataFrame:
    """The first item per canonical URL of each pull, by feed position. Null URLs are dropped."""
    return first_per_key(items.filter(F.col("url").isNotNull()), ["pull_id", "url"], F.col("pos"))


def not_held(items: DataFrame, held: DataFrame, *, small_batch: bool = False) -> DataFrame:
    """Items whose ``url`` is not in ``held``.

    With ``small_batch`` the caller says that ``items`` is cheap to read twice (a landed
    micro-batch). If its URLs then prove few, they are broadcast to the scan of ``held``, and
    the big table is filtered where it lies instead of being shuffled.
    """
    known = held.select("url")
    if small_batch:
        batch = broadcast_if_small(items.select("url"), max_rows=200_000)
        known = known.join(batch, "url", "left_semi")
    return items.join(known, "url", "left_anti")


def held_only(items: DataFrame, held: DataFrame) -> DataFrame:
    """Items whose ``url`` is held, whichever source brought it."""
    return items.join(held.select("url"), "url", "left_semi")


def mark_pages_to_fetch(
    fresh: DataFrame, role: Column, limit: int | None = None
) -> DataFrame:
    """Add ``fetch_page``: the first ``limit`` fresh items of a pull, or all, for sources of record.

    The position of the last such item is found per pull from a pre-limited ranking and joined
    back, so that a very long pull is never sorted in one task.
    """
    if limit is None:
        return fresh.withColumn("fetch_page", F.coalesce(role == "record", F.lit(False)))
    ranked = fresh.select("pull_id", "pos").withColumn(
        "rank", F.row_number().over(Window.partitionBy("pull_id").orderBy("pos"))
    )
    cut = (
        ranked.filter(F.col("rank") <= limit).groupBy("pull_id").agg(F.max("pos").alias("__last_pos"))
    )
    return (
        fresh.join(cut, "pull_id", "left")
        .withColumn(
            "fetch_page",
            F.coalesce((role == "record") & (F.col("pos") <= F.col("__last_pos")), F.lit(False)),
        )
        .drop("__last_pos")
    )


def url_quality(items: DataFrame, *keys: str) -> DataFrame:
    """Per key: items, usable URLs, distinct URLs among them."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        F.count("url").alias("n_usable"),
        F.count_distinct("url").alias("n_urls"),
    )
