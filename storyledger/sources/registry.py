"""The source registry: loading, defaults and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.schema import PRIMARY_DOMAIN_TYPES, SOURCE_KINDS, SOURCES

# Defaults of optional registry columns, and polling calendars by name
# (time zone, first hour, end hour).
DEFAULTS = {
    "source_kind": "news",
    "source_role": "record",
    "lowercase_url_path": False,
    "audit_strategy": "none",
    "active_hours_tz": "Asia/Kolkata",
    "active_start_hour": 0,
    "active_end_hour": 24,
    "active_interval_min": 15,
    "off_interval_min": 120,
    "reliability_weight": 0.7,
    "is_active": True,
}
CALENDARS = {
    "ist_business": ("Asia/Kolkata", 9, 19),
    "ist_extended": ("Asia/Kolkata", 6, 23),
    "us_weighted": ("America/New_York", 8, 22),
}
SECTION_FEED_MARKER = "NEEDS SECTION FEEDS"


def with_defaults(rows: DataFrame) -> DataFrame:
    """Registry rows with every column present and the defaults filled in."""
    columns = []
    for field in SOURCES:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]).cast(field.dataType))
        elif field.name == "topics":
            value = F.coalesce(value, F.array().cast(field.dataType))
        elif field.name == "source_id":
            value = F.coalesce(value, F.col("slug"))
        columns.append(value.alias(field.name))
    return rows.select(*columns)


def load_registry(spark: SparkSession, *paths: str) -> DataFrame:
    """Registry rows from JSON-lines seed files (one per vertical, say), with defaults."""
    return with_defaults(spark.read.schema(SOURCES).json(list(paths)))


def active_news(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("is_active") & (F.col("source_kind") == "news"))


def registry_filter(registry: DataFrame, selector: str | None = None) -> DataFrame:
    """Active news sources, those of one vertical, or the one row with that slug."""
    if not selector:
        return active_news(registry)
    key = selector.lower()
    if key in ("finance", "tech"):
        return active_news(registry).filter(F.col("vertical") == key)
    return registry.filter(F.col("slug") == key)


def auditable_sources(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("is_active") & (F.col("audit_strategy") != "none"))


def needs_section_feeds(registry: DataFrame) -> DataFrame:
    """Sources whose notes say that they are still on a site-wide feed."""
    return registry.filter(F.col("notes").contains(SECTION_FEED_MARKER)).select("slug", "name")


def primary_hosts(registry: DataFrame) -> DataFrame:
    """Distinct hosts of regulators and exchanges, active or not."""
    address = F.coalesce("index_url", "feed_url")
    bare = F.regexp_replace(F.regexp_replace(address, "^https?://", ""), r"^www\.", "")
    host = F.lower(F.substring_index(bare, "/", 1))
    return (
        registry.filter(F.col("source_type").isin(*PRIMARY_DOMAIN_TYPES))
        .select(host.alias("domain"))
        .filter(F.col("domain") != "")
        .distinct()
    )


def kind_rank(kind: Column) -> Column:
    """Sort rank of a source kind: declaration order, not alphabetical."""
    return F.array_position(F.array(*[F.lit(k) for k in SOURCE_KINDS]), kind)


def registry_listing(registry: DataFrame) -> DataFrame:
    return registry.select(
        "slug", "name", "vertical", "source_kind", "source_type", "source_role", "fetch_type",
        "audit_strategy", "reliability_weight", "is_active", "feed_url", "topics", "notes",
    ).orderBy("vertical", kind_rank(F.col("source_kind")), "name")


def duplicate_slugs(registry: DataFrame) -> DataFrame:
    """Slugs that repeat, with the names of the first and last row that carry them."""
    return (
        registry.groupBy("slug")
        .agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
        .filter(F.col("n") > 1)
    )


def assert_unique_slugs(registry: DataFrame) -> DataFrame:
    """Return the registry, or fail and name a repeated slug with both rows."""
    found = duplicate_slugs(registry).orderBy("slug").first()
    if found:
        raise ValueError(f'duplicate slug "{found.slug}" ({found.first_name} and {found.last_name})')
    return registry
