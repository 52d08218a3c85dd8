"""Sharding by a keyed permutation of global row numbers.

Rows get numbers 0..n-1 in a fixed order. A Feistel network over an a x b grid that just covers
n permutes the numbers; a number that falls outside walks on along its cycle until it is inside.
Shard and slot follow from the permuted number by division, so a row's place can be computed from
its number and the seed alone, and counts of shards differ by one at most.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.llm.runs import sorted_parts, with_row_number
from storyledger.llm.text import hidden

PRIME = 2**31 - 1
ROUNDS = 6
# Fewer than one number in sqrt(n) lies outside the grid's first n, so 64 further steps never occur in
# practice, and provably not below 4096 rows; a walk that is not home then raises instead of guessing.
STEPS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and summand of every round."""
    keys = []
    for i in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        keys.append(
            (int.from_bytes(digest[:4], "big") % (PRIME - 1) + 1, int.from_bytes(digest[4:8], "big") % PRIME)
        )
    return keys


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of ``number`` (0..n-1) in a permutation of 0..n-1 that ``seed`` fixes."""
    a, b = (F.lit(x).cast("bigint") for x in grid(n))
    keys = F.array(
        *[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(c).cast("bigint").alias("c")) for m, c in round_keys(seed)]
    )

    def state(x: Column, y: Column, mx: Column, my: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), mx.alias("mx"), my.alias("my"))

    def one_round(s: Column, key: Column) -> Column:
        mixed = (s["y"] * key["m"] + key["c"]) % PRIME
        return state(s["y"], (s["x"] + mixed * mixed % PRIME) % s["mx"], s["my"], s["mx"])

    def network(value: Column) -> Column:
        start = state(F.call_function("div", value, b), value % b, a, b)
        return F.aggregate(keys, start, one_round, lambda s: s["x"] * b + s["y"])

    inside = F.lit(n).cast("bigint")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        network(number),
        lambda p, _: F.when(p < inside, p).otherwise(network(p)),
    )
    lost = F.raise_error(F.lit("permutation: walk did not end")).cast("bigint")
    return F.when(walked < inside, walked).otherwise(lost)


def shard(df: DataFrame, order: list[str], n_shards: int, *, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Rows are numbered in ``order``. Rows that tie in all order columns take neighbouring numbers in
    either order; pass enough columns to tell them apart. Nulls come first. An empty table stays
    empty. Columns named ``shard`` or ``slot`` are replaced.
    """
    parts = sorted_parts(df.drop("shard", "slot"), order, "shards")
    n = parts.count()
    number = hidden(parts, "__number")
    numbered = with_row_number(parts, number)
    place = permuted(F.col(number), n, seed)
    spot = hidden(numbered, "__spot")
    placed = numbered.withColumn(spot, place).drop(number)
    return placed.withColumns(
        {
            "shard": (F.col(spot) % n_shards).cast("int"),
            "slot": F.call_function("div", F.col(spot), F.lit(n_shards)).cast("bigint"),
        }
    ).drop(spot)


def write_shards(sharded: DataFrame, path: str, n_shards: int) -> None:
    """One folder a shard, rows in slot order."""
    ordered = sharded.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)
