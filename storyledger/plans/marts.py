"""Marts: source health, totals, registry summaries, listings and feeds.

Every mart takes ``asof`` instead of reading a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.claims import claim
from storyledger.functions.steps import pinned
from storyledger.functions.text import snippet
from storyledger.functions.times import age_text, is_active_hour, known_zone
from storyledger.sizing import broadcast_if_small

DAY, WEEK = "24 hours", "7 days"


def _within(column: str, asof: Column, period: str) -> Column:
    return F.col(column) > asof - F.expr(f"INTERVAL {period}")


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in percent, null when there is nothing to share."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0))).cast("int")


def source_health(
    registry: DataFrame, docs: DataFrame, log: DataFrame, errors: DataFrame, asof: Column
) -> DataFrame:
    """Per news source: document counts, image share, peak of new items, open errors, last error.

    Each fact table is read once and folded to one row per source on the map side; only those
    rows are joined.
    """
    week = _within("fetched_at", asof, WEEK)
    per_docs = docs.groupBy("source_id").agg(
        F.count_if(_within("fetched_at", asof, DAY)).alias("docs_24h"),
        F.count("*").alias("docs_total"),
        percent(F.count_if(week & F.col("image_url").isNotNull()), F.count_if(week)).alias("image_pct_7d"),
    )
    failed = F.col("error").isNotNull()
    per_log = log.groupBy("source_id").agg(
        F.max(F.when(_within("attempted_at", asof, WEEK), F.col("items_new"))).alias("peak_new"),
        F.max_by("error", F.when(failed, F.col("attempted_at"))).alias("last_error"),
    )
    return health_rows(registry, per_docs, per_log, errors)


def health_rows(registry: DataFrame, per_docs: DataFrame, per_log: DataFrame, errors: DataFrame) -> DataFrame:
    """News sources with what documents, log and open errors say about each."""
    per_errors = (
        errors.filter(F.col("resolved_at").isNull()).groupBy("source_id").agg(F.count("*").alias("open_errors"))
    )
    out = registry.filter(F.col("source_kind") == "news")
    for part in (per_docs, per_log, per_errors):
        out = out.join(part, "source_id", "left")
    return out.select(
        "source_id", "slug", "name", "vertical", "source_type", "source_role", "fetch_type",
        "audit_strategy", "is_active", "last_fetched_at", "next_fetch_at", "active_interval_min",
        "off_interval_min", "active_hours_tz", "active_start_hour", "active_end_hour",
        "feed_window_size", "notes",
        F.coalesce("docs_24h", F.lit(0)).alias("docs_24h"),
        F.coalesce("docs_total", F.lit(0)).alias("docs_total"),
        "image_pct_7d",
        "peak_new",
        F.coalesce("open_errors", F.lit(0)).alias("open_errors"),
        "last_error",
    ).orderBy("vertical", "name")


def is_stale(asof: Column, *, use_calendar: bool = False) -> Column:
    """Active, polled before, and two polls overdue.

    By default the active interval counts at all hours; ``use_calendar`` takes the off-hours
    interval outside the active hours.
    """
    minutes = F.col("active_interval_min")
    if use_calendar:
        active = is_active_hour(
            asof, known_zone(F.col("active_hours_tz")), F.col("active_start_hour"), F.col("active_end_hour")
        )
        minutes = F.when(active, minutes).otherwise(F.col("off_interval_min"))
    age = (F.unix_micros(asof) - F.unix_micros("last_fetched_at")) / 60_000_000
    return F.coalesce(F.col("is_active") & (age > 2 * minutes), F.lit(False))


def is_under_polled() -> Column:
    """A whole feed window came back new, so older items may have been missed."""
    window = F.col("feed_window_size")
    return F.coalesce((window > 0) & (F.col("peak_new") >= window), F.lit(False))


def health_status(health: DataFrame, asof: Column, *, use_calendar: bool = False) -> DataFrame:
    """Health rows with flags, one status by precedence, and the age of the last poll."""
    stale = is_stale(asof, use_calendar=use_calendar)
    return health.select(
        "*",
        stale.alias("is_stale"),
        is_under_polled().alias("is_under_polled"),
        F.when(~F.col("is_active"), "inactive")
        .when(F.col("open_errors") > 0, "failing")
        .when(stale, "stale")
        .when(is_under_polled(), "under-polled")
        .when(F.col("last_fetched_at").isNull(), "pending")
        .otherwise("ok")
        .alias("health"),
        age_text(F.col("last_fetched_at"), asof).alias("last_fetch_age"),
    )


def totals(registry: DataFrame, docs: DataFrame, errors: DataFrame, asof: Column) -> DataFrame:
    """Global counters."""
    day = _within("fetched_at", asof, DAY)
    counts = docs.agg(
        F.count("*").alias("docs_total"),
        F.count_if(day).alias("docs_24h"),
        F.count_if(day & F.col("origin_wire_byline").isNotNull()).alias("wire_flagged_24h"),
        F.count_if(day & F.col("image_url").isNotNull()).alias("with_image_24h"),
    )
    return totals_of(registry, counts, errors)


def totals_of(registry: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of registry, documents (one row) and errors, stacked and folded, so there is no join."""
    news = F.col("source_kind") == "news"
    parts = [
        registry.agg(
            F.count_if(news).alias("sources_news"),
            F.count_if(F.col("source_kind") == "data").alias("sources_data"),
            F.count_if(news & F.col("is_active")).alias("sources_active"),
        ),
        counts,
        errors.agg(F.count_if(F.col("resolved_at").isNull()).alias("open_errors")),
    ]
    names = [c for part in parts for c in part.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    folded = stacked.agg(*[F.max(c).alias(c) for c in names])
    share = F.floor(100 * F.col("with_image_24h") / F.nullif("docs_24h", F.lit(0)) + 0.5)
    return folded.withColumn("image_pct_24h", share.cast("int"))


def registry_summary(registry: DataFrame) -> DataFrame:
    """Per vertical: rows, news, active news, data, audited news, scraped news."""
    news = F.col("source_kind") == "news"
    return registry.groupBy("vertical").agg(
        F.count("*").alias("rows"),
        F.count_if(news).alias("news"),
        F.count_if(news & F.col("is_active")).alias("active_news"),
        F.count_if(~news).alias("data"),
        F.count_if(news & (F.col("audit_strategy") != "none")).alias("audited"),
        F.count_if(news & (F.col("fetch_type") == "scrape")).alias("scrapers"),
    )


def registry_active(registry: DataFrame) -> DataFrame:
    return registry.groupBy("vertical").agg(
        F.count_if("is_active").alias("active"), F.count("*").alias("total")
    )


def recent_documents(docs: DataFrame, registry: DataFrame, limit: int = 100) -> DataFrame:
    """Newest fetched first. The top rows are taken before the registry is joined."""
    top = docs.select(
        "source_id", "url", "title", "vertical", "fetched_at", "published_at",
        "published_at_confidence", "extraction_status",
        F.char_length("text_content").alias("text_length"),
        "origin_wire_byline", "origin_wire_evidence", "origin_primary_links",
        "origin_discovery_target_url", "image_url", "image_source", "image_width",
    )
    known = registry.select("source_id", F.col("name").alias("source_name"))
    return (
        top.join(broadcast_if_small(known), "source_id")
        .orderBy(F.desc("fetched_at"), "url")
        .limit(limit)
    )


def feed(
    docs: DataFrame,
    registry: DataFrame,
    asof: Column,
    vertical: str | None = None,
    limit: int = 60,
    text_col: str = "text_content",
) -> DataFrame:
    """Documents as cards, newest published first; the claim is derived from the snippet.

    Snippet and claim are computed for the rows that are shown, after the top-k.
    """
    rows = docs if vertical is None else docs.filter(F.col("vertical") == vertical)
    known = registry.select(
        "source_id", F.col("name").alias("source_name"), "source_type", "source_role",
        "reliability_weight", "topics",
    )
    top = (
        rows.select(
            "source_id", "url", "title", "vertical", "published_at", "published_at_confidence",
            "fetched_at", "image_url", "origin_wire_byline", "origin_primary_links", text_col,
        )
        .join(broadcast_if_small(known), "source_id")
        .orderBy(F.desc("published_at"), F.desc("fetched_at"), "url")
        .limit(limit)
    )
    # Pinned twice, so that no projection slips below the limit and turns the top-k into a full sort.
    kept = [c for c in top.columns if c != text_col]
    cards = pinned(top, kept, {"snippet": snippet(F.col(text_col))})
    verdict = claim(F.col("source_role"), F.col("source_type"), F.col("snippet"))
    return pinned(
        cards,
        cards.columns,
        {
            "card_text": F.left("snippet", F.lit(260)),
            "claim_type": verdict["claim_type"],
            "date_is_approximate": F.col("published_at_confidence") != "high",
            "age": age_text(F.col("published_at"), asof, days_from_hours=24),
        },
    )
