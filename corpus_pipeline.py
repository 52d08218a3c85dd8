"""The corpus pipeline: language, near duplicates, benchmark, mix, shards.

Each stage reads what the one before it wrote as Parquet and keeps the columns of ``documents``; the last one
adds ``shard`` and ``slot``. ``ORACLE_SQL`` is None: character models and consistent sampling have no SQL form, so
the tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.llm import decontaminate, language, mixing, near_dup, queries, shards
from storyledger.llm.text import hidden
from storyledger.session import landed, work_dir

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is rejected go: null, without a letter, or unlike every language learned."""
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least identifier."""
    return near_dup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 10 consecutive words with a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each pass of the mix that takes words of them.

    A document whose last pass is cut by its source's target comes whole. Rows that share an identifier are
    parts of one document: their sizes add up, and they are taken together. Documents without words, which no demand
    can reach, come once, after all others.
    """
    sizes = queries.mix_rows(docs).groupBy("doc_id", "tie").agg(F.max("source").alias("source"), F.sum("size").alias("size"))
    rows = landed(sizes, "mix-sizes")
    targets = landed(mixing.source_targets(rows, queries.cyclic_weight()), "mix-targets")
    placed = mixing.place(rows, targets, mixing.SHAPES)
    own_id, own_tie, position = (hidden(docs, name) for name in ("__id", "__tie", "__position"))
    wordless = F.array(F.lit(2.0))
    times = F.when(F.col("size") > 0, F.transform("placements", lambda p: p["position"])).otherwise(wordless)
    plan = landed(placed.select(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie), F.explode(times).alias(position)), "mix-plan")
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(own_id)))
    order = [position, own_tie]
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; rows are numbered by identifier, then by text.

    Columns of other names come back as they were; ``shard`` and ``slot`` are replaced.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*kept).alias("row"), "doc_id", digest.alias("digest"))
    return shards.shard(rows, ["doc_id", "digest"], queries.N_SHARDS, seed=7).select("row.*", "shard", "slot")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
