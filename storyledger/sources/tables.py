"""Readers and writers of the five stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.schema import TABLES

PARTITION_COLUMN = {"raw_documents": "fetch_date", "coverage_audit": "audit_date"}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a stored table with its declared schema; no inference, so no extra file pass."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Append rows, or overwrite just the partitions that ``df`` holds rows of."""
    out = df
    if name == "raw_documents" and "fetch_date" not in df.columns:
        out = out.withColumn("fetch_date", F.to_date("fetched_at"))
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if name in PARTITION_COLUMN:
        writer = writer.partitionBy(PARTITION_COLUMN[name])
    writer.parquet(f"{root}/{name}")


def fetched_since(docs: DataFrame, asof: Column, interval: str) -> DataFrame:
    """Documents fetched within ``interval`` before ``asof``.

    Where the table is partitioned by ``fetch_date`` the same bound is put on that column, so
    that older partitions are never listed.
    """
    since = asof - F.expr(f"INTERVAL {interval}")
    out = docs.filter(F.col("fetched_at") > since)
    if "fetch_date" in docs.columns:
        out = out.filter(F.col("fetch_date") >= F.to_date(since))
    return out
