"""Positions and running totals over a whole table, without one task that sees all of it.

Rows are range-partitioned and sorted once, and land in the shared folder with the number of
their part. Totals of the parts are few rows; their running sum starts every part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyledger.session import landed

PART, PLACE = "__part", "__place"
PART_BITS = 33  # monotonically_increasing_id: the part above, the row within it below


def sorted_parts(df: DataFrame, order: Sequence[str | Column], purpose: str) -> DataFrame:
    """``df`` in ``order`` with ``__part`` and ``__place`` (from 0 in each part), landed.

    Order columns should break ties; rows that tie in all of them may swap places.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, place)
    split = ranged.withColumn(PART, F.shiftright(PLACE, PART_BITS)).withColumn(
        PLACE, F.col(PLACE).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    )
    return landed(split, purpose)


def starts(parts: DataFrame, value: Column) -> DataFrame:
    """``__part`` and the total of ``value`` in all parts before it; one row a part."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(PART).agg(F.sum(value).alias("__sum"))
    return sums.select(PART, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))


def with_row_number(parts: DataFrame, out: str) -> DataFrame:
    """Global row number from 0 of a frame from ``sorted_parts``."""
    # As many rows as range partitions, so the broadcast is bounded by the session's setting.
    joined = parts.join(F.broadcast(starts(parts, F.lit(1))), PART)
    return joined.withColumn(out, F.col("__start") + F.col(PLACE)).drop(PART, PLACE, "__start")


def with_running_total(parts: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one, for a frame from ``sorted_parts``."""
    inside = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(starts(parts, F.col(value))), PART)
    total = F.col("__start") + F.sum(value).over(inside) - F.col(value)
    return joined.withColumn(out, total).drop(PART, PLACE, "__start")
