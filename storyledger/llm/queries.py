"""Queries of the training-data operators over the benchmark tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.llm import (
    align,
    decontaminate,
    exact_dup,
    fim,
    language,
    licenses,
    mixing,
    near_dup,
    repeats,
    shards,
    token_counts,
    url_rules,
    warc,
)
from storyledger.llm.text import SPACED_WORD, count_matches
from storyledger.session import landed, work_dir

Query = Callable[[SparkSession, str], DataFrame]

# The rules that op3 judges by.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
N_SHARDS = 16
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MIX_SEED = "mix"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cyclic_weight() -> Column:
    """1, 2, 3, repeating, by the place of a source."""
    return F.col("rank") % 3 + 1


def mix_rows(docs: DataFrame) -> DataFrame:
    size = count_matches(F.col("text"), SPACED_WORD)
    return docs.select("doc_id", "source", size.alias("size"), mixing.tie_order(F.col("doc_id"), MIX_SEED).alias("tie"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landed(mix_rows(table(spark, sf_dir, "documents")), "mix-sizes")
    targets = landed(mixing.source_targets(rows, cyclic_weight()), "mix-targets")
    placed = mixing.place(rows, targets, mixing.SHAPES)
    listed = placed.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("placements", F.lit(0).cast("bigint"), lambda total, p: total + p["words"]).alias("taken"),
        F.size("placements").cast("bigint").alias("copies"),
        F.round(F.array_min(F.transform("placements", lambda p: p["position"])), 6).alias("first_position"),
        "tie",
    )
    order = ["first_position", "tie"]
    return listed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")


def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").alias("key"), "lang", "text")
    model = language.fit(rows.where(~language.held_out(F.col("key"))), F.col("key"))
    judged = language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op3_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules, "url", "page_id").select("page_id", "host", "path", "rule", "verdict")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    judged = decontaminate.contamination(docs, items, {"doc_id": F.col("doc_id")})
    digest = F.sha2(F.array_join("items", ","), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op5_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER), ["doc_id"])


def op6_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")
    )
    sharded = shards.shard(rows, ["doc_id", "digest"], N_SHARDS, seed=7)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dup.near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    captures = warc.assemble(warc.read_archives(spark, folder))
    page = F.regexp_extract("metadata.fields", r"(?m)^pageId: (-?[0-9]+)\r?$", 1).try_cast("bigint")
    return captures.where("main is not null").select(
        page.alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        warc.page_key(F.col("main.refers_to")).alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha256").alias("text_sha256")
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.digests(fim.pieces(table(spark, sf_dir, "documents")))
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = align.aligned(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = align.numbered(found.withColumn("groups_sha256", digest).drop("groups"))
    scored = align.with_scores(rows, landed(align.pair_counts(rows), "pair-counts"))
    return scored.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cleaned.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in (
        op1_mix_sources, op2_identify_language, op3_judge_urls, op4_decontaminate, op5_count_tokens,
        op6_scan_licenses, op7_shard, op8_near_duplicates, op9_warc, op10_exact_dedup, op11_fill_in_middle,
        op12_align_tokenizers, op13_remove_repeats,
    )
}
