"""Checks that stand in for constraints: domains, references and keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyledger.schema import DOMAINS, KEYS
from storyledger.sizing import broadcast_if_small


def enum_violations(table: DataFrame, name: str) -> DataFrame:
    """Values outside their domain: ``table_name``, ``column_name``, ``value``, ``n``.

    One pass: each row yields its bad values, so the table is not read once per column.
    """
    checks = [
        F.when(
            F.col(column).isNotNull() & ~F.col(column).isin(*domain),
            F.struct(F.lit(column).alias("column_name"), F.col(column).alias("value")),
        )
        for column, domain in DOMAINS[name].items()
        if column in table.columns
    ]
    bad = table.select(F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("bad"))
    return bad.groupBy(
        F.lit(name).alias("table_name"),
        F.col("bad")["column_name"].alias("column_name"),
        F.col("bad")["value"].alias("value"),
    ).agg(F.count("*").alias("n"))


def orphans(fact: DataFrame, registry: DataFrame, name: str) -> DataFrame:
    """Facts whose source is not registered: ``table_name``, ``source_id``, ``n``.

    Facts fold to one row per source before the join.
    """
    return (
        fact.groupBy("source_id")
        .agg(F.count("*").alias("n"))
        .join(broadcast_if_small(registry.select("source_id")), "source_id", "left_anti")
        .select(F.lit(name).alias("table_name"), "source_id", "n")
    )


def unique_violations(table: DataFrame, name: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Repeated key values: ``table_name``, ``key_value``, ``n``."""
    columns = list(keys or KEYS[name])
    return (
        table.groupBy(*columns)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(
            F.lit(name).alias("table_name"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key_value"),
            "n",
        )
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
