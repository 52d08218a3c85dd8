"""Running values over long ordered histories, without one task per key.

A window over a whole key would put the history of a hot key into one task. Here rows are range-partitioned by key and
time, so a hot key spans as many parts as its rows fill, whatever hours they fall into. Each part folds its rows of a key
to one summary that composes (what follows the last reset, and whether there was one; the first event), the summaries
of a key are chained over its parts, and what the chain carries into a part completes the rows there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyledger.session import landed

PART, PLACE = "__part", "__place"
PART_BITS = 33  # monotonically_increasing_id: the part above, the row within it below


def ranged_parts(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in ``order`` with ``__part`` and ``__place`` in it, landed, so that both stay what they are."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, place)
    return landed(ranged.withColumn(PART, F.shiftright(PLACE, PART_BITS).cast("int")), "ranged")


def hits_since_reset(df: DataFrame, key: str, at: str, tie: str, hit: Column, reset: Column, out: str) -> DataFrame:
    """Count ``hit`` rows of the key since its last ``reset`` row, the current row included."""
    marked = df.select(
        "*", F.coalesce(hit, F.lit(False)).cast("long").alias("__hit"), F.coalesce(reset, F.lit(False)).alias("__reset")
    )
    rows = ranged_parts(marked, key, at, tie)
    inside = Window.partitionBy(PART, key).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__hits", F.sum("__hit").over(inside))
    rows = rows.withColumn(
        "__base", F.max(F.when(F.col("__reset"), F.col("__hits"))).over(inside)
    ).withColumn("__since", F.col("__hits") - F.coalesce("__base", F.lit(0)))

    # A part's summary: hits after its last reset, and whether it had one. Two summaries compose to another.
    parts = rows.groupBy(key, PART).agg(F.max_by("__since", PLACE).alias("__tail"), F.bool_or("__reset").alias("__any_reset"))
    chain = Window.partitionBy(key).orderBy(PART)  # as many rows as parts
    so_far = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("__total", F.sum("__tail").over(so_far)).withColumn(
        "__state",
        F.col("__total")
        - F.coalesce(F.max(F.when(F.col("__any_reset"), F.col("__total") - F.col("__tail"))).over(so_far), F.lit(0)),
    )
    carried = parts.select(key, PART, F.coalesce(F.lag("__state").over(chain), F.lit(0)).alias("__carry"))
    joined = rows.join(carried, [key, PART])
    value = F.col("__since") + F.when(F.col("__base").isNull(), F.col("__carry")).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(out))


def next_event(df: DataFrame, key: str, at: str, event: Column, out: str, *, strict: bool = True) -> DataFrame:
    """Time of the first ``event`` row of the key after each other row, or null.

    An event of the same instant counts only if not ``strict``.
    """
    marked = df.select("*", F.when(event, F.col(at)).alias("__event"))
    # Which of the rows of one instant come first decides whether an event there is still ahead.
    late = F.col("__event").isNull() if strict else F.col("__event").isNotNull()
    # Latest first: what is ahead of a row is then a running value of the rows before it. A frame from a row to the end
    # of its window would be folded anew for every row.
    rows = ranged_parts(marked.withColumn("__late", late), key, F.desc(at), F.desc("__late"))
    ahead = Window.partitionBy(PART, key).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__near", F.min("__event").over(ahead))
    parts = rows.groupBy(key, PART).agg(F.min("__event").alias("__first"))
    later = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    far = parts.select(key, PART, F.min("__first").over(later).alias("__far"))
    joined = rows.join(far, [key, PART])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__near", "__far").alias(out))
