"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, piecewise linear over training time 0..1. The area under it is the
source's weight: it fixes the share of all tokens, capped at a number of passes over the source. The
cumulative area is the source's cumulative token demand; the k-th token of a source is placed at the time
when its demand reaches k. Inverting the demand is a quadratic for each linear piece, so a document's
position is a closed form of the tokens before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyledger.llm.runs import sorted_parts, with_running_total
from storyledger.sizing import broadcast_if_small

Knots = Sequence[tuple[float, float]]
FLAT: Knots = ((0.0, 1.0), (1.0, 1.0))
# Relative weight over time; each shape has the area 1. The first rises, the second is flat, the third falls.
SHAPES: tuple[Knots, ...] = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.25), (0.5, 1.25), (1.0, 0.25)),
)
MAX_PASSES = 3


def pieces(knots: Knots) -> list[tuple[float, float, float, float, float, float]]:
    """Start, length, weight at both ends and share of the area before and after, for each linear piece."""
    spans = [(t0, t1 - t0, w0, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole = sum(s[4] for s in spans)
    if whole <= 0 or any(s[1] <= 0 or s[2] < 0 or s[3] < 0 for s in spans):
        raise ValueError("a schedule needs rising times, no negative weight and a positive area")
    out, before = [], 0.0
    for t0, length, w0, w1, area in spans:
        out.append((t0, length, w0 / whole, w1 / whole, before / whole, (before + area) / whole))
        before += area
    return out


def inverse_demand(share: Column, knots: Knots) -> Column:
    """Time at which the cumulative demand reaches ``share`` (0..1) of its total."""
    time = F.lit(None).cast("double")
    for t0, length, w0, w1, before, after in reversed(pieces(knots)):
        left = share - F.lit(before)
        slope = (w1 - w0) / length
        # Area w0 x + slope x^2 / 2 = left, in the form that stays exact for a flat piece.
        root = F.lit(2.0) * left / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * left, F.lit(0.0))))
        found = F.lit(t0) + F.least(F.coalesce(root, F.lit(0.0)), F.lit(length))
        time = found if time is None else F.when(share < F.lit(after), found).otherwise(F.coalesce(time, found))
    return time


def source_targets(sizes: DataFrame, weight: Column, max_passes: int = MAX_PASSES) -> DataFrame:
    """Demand of each source: ``source``, ``source_size``, ``rank``, ``weight``, ``target``.

    ``sizes`` has ``source`` and ``size``; ``weight`` may refer to ``rank``, the place of the source by code
    point from 0, null last. Targets share the total size by weight; none is above ``max_passes`` times its
    source, what is over goes to the others by weight. Capped sources are a prefix in the order of cap
    over weight, so one running sum over the sources finds the level of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("double"))
    capped = ranked.withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = capped.withColumns(
        {
            "rest": F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # The first source in this order whose fair part is within its cap sets the level for all after it.
    fits = F.col("weight") * (F.col("rest") / F.col("open")) <= F.col("cap")
    found = level.withColumn("first", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "rank", "rest", "open"))).over(everything))
    share = F.col("weight") * (F.col("first.rest") / F.col("first.open"))
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(share, F.col("cap")))
    return found.select("source", "source_size", "rank", "weight", target.alias("target"))


def place(rows: DataFrame, targets: DataFrame, shapes: Sequence[Knots] = (FLAT,)) -> DataFrame:
    """``rows`` (``source``, ``size``, ``tie`` and others) with ``source_size``, ``target``, ``placements``.

    Inside a source, rows stand in the order of ``tie``, the same in every pass. A placement
    (``pass``, ``words``, ``position``) says how many words a pass takes of the row and when; the last
    one of a source may take only the words that its target still needs. Rows of no words have no placement.
    """
    whole = targets.withColumn("before", F.coalesce(F.sum("source_size").over(
        Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    small = broadcast_if_small(whole)
    ranked = rows.join(small.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    parts = sorted_parts(ranked, ["rank", "tie"], "mix")
    running = with_running_total(parts, "size", "__total")
    own = F.col("__total") - F.col("before")
    end = F.floor(F.col("target") + 0.5)
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.col("source_size")) - 1, F.lit(0)).cast("int"))

    def placement(number: Column) -> Column:
        start = number * F.col("source_size") + own
        share = start / F.col("target")
        when = F.lit(None).cast("double")
        for i, knots in enumerate(shapes):
            when = F.when(F.col("rank") % len(shapes) == i, inverse_demand(share, knots)).otherwise(when)
        return F.struct(
            number.cast("int").alias("pass"),
            F.least(F.col("size"), F.greatest(end - start, F.lit(0))).cast("bigint").alias("words"),
            when.alias("position"),
        )

    taken = F.filter(F.transform(passes, placement), lambda p: p["words"] > 0)
    none = F.array().cast("array<struct<pass: int, words: bigint, position: double>>")
    return running.withColumn("placements", F.when(F.col("target") > 0, taken).otherwise(none)).drop("before", "__total")


def training_order(placed: DataFrame) -> DataFrame:
    """One row for each placement, range-sorted by position; ``placements`` gives way to its fields."""
    each = placed.select("*", F.inline("placements")).drop("placements")
    return each.repartitionByRange("position", "rank", "tie").sortWithinPartitions("position", "rank", "tie")


def tie_order(key: Column, seed: str) -> Column:
    """A shuffled but fixed order of rows: hash of the key first, then the key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(seed + ":"), text)), text)
