"""Provenance jobs: links to primary publishers and independent source counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.claims import is_strong_wire
from storyledger.functions.steps import pinned
from storyledger.functions.urls import canonical_urls, is_same_domain
from storyledger.sizing import broadcast_if_small

# A domain list this short is compared inside the row; a longer one is joined.
MAX_INLINE_DOMAINS = 1_000


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``: every domain the host belongs to, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def link_hosts(hrefs: str) -> Column:
    """Distinct canonical hosts of a column of absolute links."""
    hosts = F.transform(canonical_urls(hrefs), lambda u: u["host"])
    return F.array_distinct(F.filter(hosts, lambda h: h.isNotNull()))


def with_primary_links(
    docs: DataFrame,
    hrefs_col: str,
    page_host: Column,
    domains: DataFrame,
    *,
    key: str,
    out: str = "origin_primary_links",
) -> DataFrame:
    """Add the sorted distinct primary domains that a document links to, minus its own.

    Per link the most specific domain counts. ``domains`` has one column, ``domain``. A list
    proven short becomes one array value and is compared inside the row, so wide document rows
    never move. A longer one is equi-joined on exploded host suffixes by ``key``.
    """
    staged = docs.withColumn("__hosts", link_hosts(hrefs_col))
    n_domains = domains.limit(MAX_INLINE_DOMAINS + 1).count()
    if n_domains <= MAX_INLINE_DOMAINS:
        known = domains.agg(F.collect_set("domain")).scalar()
        staged = staged.withColumn("__known", known)
        hits = F.transform(
            F.col("__hosts"),
            lambda h: F.get(
                F.filter(host_suffixes(h), lambda s: F.array_contains(F.col("__known"), s)), F.lit(0)
            ),
        )
        found = F.filter(
            F.array_distinct(hits), lambda d: d.isNotNull() & ~is_same_domain(page_host, d)
        )
        none = F.array().cast("array<string>")
        return pinned(staged, docs.columns, {out: F.coalesce(F.array_sort(found), none)})

    per_host = staged.select(key, page_host.alias("__page"), F.explode("__hosts").alias("__host"))
    per_suffix = per_host.select("*", F.explode(host_suffixes(F.col("__host"))).alias("domain"))
    matched = (
        per_suffix.join(broadcast_if_small(domains), "domain")
        .groupBy(key, "__page", "__host")
        .agg(F.max_by("domain", F.length("domain")).alias("domain"))
        .filter(~is_same_domain(F.col("__page"), F.col("domain")))
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("domain")).alias(out))
    )
    return (
        staged.drop("__hosts")
        .join(matched, key, "left")
        .withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    )


def independent_sources(docs: DataFrame, story_key: str) -> DataFrame:
    """Per story: independent sources, documents, and documents by what they count as.

    Discovery sources never count. Strong wire copy counts once per agency, everything else
    once per source. The distinct count is two-phase: rows fold to (story, voice) before the
    story-level count, so one huge story does not end up in one task.
    """
    role, source = F.col("source_role"), F.col("source_id")
    strong = is_strong_wire(F.col("wire_evidence"))
    voice = F.when(
        role == "record",
        F.when(strong, F.concat(F.lit("wire:"), F.col("wire_agency"))).otherwise(
            F.concat(F.lit("src:"), source)
        ),
    )
    voices = (
        docs.select(story_key, voice.alias("voice"), strong.alias("strong"))
        .groupBy(story_key, "voice")
        .agg(F.count("*").alias("n"), F.count_if("strong").alias("n_strong"))
    )
    return voices.groupBy(story_key).agg(
        F.count("voice").alias("independent_sources"),
        F.sum("n").alias("documents"),
        F.sum(F.when(F.col("voice").isNotNull(), F.col("n_strong")).otherwise(0)).alias("wire_copies"),
        F.sum(F.when(F.col("voice").isNull(), F.col("n")).otherwise(0)).alias("discovery_documents"),
    )


def mix(docs: DataFrame, *columns: str) -> DataFrame:
    """Distribution of one or more columns: how many rows have each value."""
    return docs.groupBy(*columns).agg(F.count("*").alias("n"))


def mix_pivot(docs: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """The same as one row per ``by`` with a column per value; nulls count under ``none``."""
    value = F.coalesce(F.col(column), F.lit("none"))
    return docs.groupBy(by).agg(
        *[F.count_if(value == v).alias(f"n_{v}") for v in [*values, "none"]]
    )
