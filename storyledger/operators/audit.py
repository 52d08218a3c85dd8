"""Coverage audits: what a publisher's own index lists against what is held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyledger.functions.urls import with_canonical_url
from storyledger.operators.identity import first_per_key
from storyledger.operators.ordered import next_event
from storyledger.session import landed
from storyledger.sizing import broadcast_if_small
from storyledger.sources.registry import auditable_sources
from storyledger.sources.tables import fetched_since

# How many missing URLs are stored and shown.
MAX_STORED_MISSING = 50
MAX_SHOWN_MISSING = 5
# 200 000 URLs are about 20 MB.
MAX_BROADCAST_URLS = 200_000
CALENDAR_NOTE = "compared with the index only; releases that are late are found by the calendar"
PROXY_NOTE = "links of a discovery feed; a missing one is a lead, not a proven miss"
PROXY_EMPTY_NOTE = "no discovery link within a day"
NO_PATTERN = "the source has no index_link_pattern"
NO_MATCH = "no link of the index fits the pattern"


def compare_with_held(
    expected: DataFrame, held: DataFrame, key: str = "source_id", stored: int = MAX_STORED_MISSING
) -> DataFrame:
    """Per key: expected, ingested and missing URLs, with the first missing ones by ``pos``.

    ``expected`` has the key, ``url`` and ``pos``. Repeated URLs of a key fold to their first
    position before anything is joined. Missing URLs are ranked with a limit, so at most
    ``stored`` per key and task reach the final list; ``missing_pages`` has all of them as rows.
    """
    unique = expected.filter(F.col("url").isNotNull()).groupBy(key, "url").agg(F.min("pos").alias("pos"))
    unique = landed(unique, "expected")
    # The store is filtered where it lies by the URLs asked for; only its hits are made unique.
    asked = broadcast_if_small(unique.select("url"), MAX_BROADCAST_URLS)
    known = held.select("url").join(asked, "url", "left_semi").distinct().withColumn("__held", F.lit(True))
    marked = unique.join(known, "url", "left").withColumn("__held", F.col("__held").isNotNull())
    counts = marked.groupBy(key).agg(
        F.count("*").alias("expected_count"), F.count_if("__held").alias("ingested_count")
    )
    first = Window.partitionBy(key).orderBy("pos", "url")
    missing = (
        marked.filter(~F.col("__held"))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= stored)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("__rows"))
        .select(key, F.transform("__rows", lambda r: r["url"]).alias("missing_urls"))
    )
    return counts.join(missing, key, "left").withColumn(
        "missing_urls", F.coalesce("missing_urls", F.array().cast("array<string>"))
    )


def missing_pages(expected: DataFrame, held: DataFrame, key: str = "source_id") -> DataFrame:
    """Every expected URL that is not held, with the key and its first ``pos``: one row each."""
    unique = expected.filter(F.col("url").isNotNull()).groupBy(key, "url").agg(F.min("pos").alias("pos"))
    return unique.join(held.select("url"), "url", "left_anti").select(key, "url", "pos")


def _verdict(df: DataFrame) -> DataFrame:
    gap = F.col("expected_count") > F.col("ingested_count")
    return df.withColumn("status", F.when(gap, "gap").otherwise("ok"))


def audit_index_diff(
    harvested: DataFrame, held: DataFrame, registry: DataFrame, stored: int = MAX_STORED_MISSING
) -> DataFrame:
    """Audit by index: harvested pages of each source against all held URLs, whatever their date.

    ``harvested`` comes from ``scrape_pages``, that is, from the same links as ingestion reads.
    """
    facts = registry.select("source_id", "audit_strategy", "lowercase_url_path")
    links = (
        harvested.filter(F.col("error_kind").isNull())
        .select("source_id", F.posexplode("links").alias("pos", "link"))
        .select("source_id", "pos", F.col("link")["url"].alias("link_url"))
        .join(broadcast_if_small(facts.select("source_id", "lowercase_url_path")), "source_id")
    )
    expected = with_canonical_url(links, "link_url", lowercase=F.col("lowercase_url_path"))
    # What failed before the page was read is the cause; what it looked like then is not.
    rank = F.when(F.col("error_kind").isin("network", "http"), 0).when(F.col("error_kind").isNull(), 2).otherwise(1)
    if "http_status" not in harvested.columns:
        harvested = harvested.withColumn("http_status", F.lit(None).cast("int"))
    bad = harvested.withColumn("__rank", rank).groupBy("source_id").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("error_kind").isNull()).alias("n_good"),
        F.min_by("error_kind", F.struct("__rank", "error_kind")).alias("kind"),
        F.max(F.when(F.col("error_kind") == "http", F.col("http_status"))).cast("int").alias("http_status"),
    )
    note = F.when(F.col("audit_strategy") == "calendar_expect", CALENDAR_NOTE)
    compared = _verdict(compare_with_held(expected, held, stored=stored)).join(facts, "source_id").join(bad, "source_id")
    failed = F.col("n_pages") - F.col("n_good")
    partly = F.when(
        failed > 0, F.format_string("%d of %d index pages failed (%s)", failed, F.col("n_pages"), F.col("kind"))
    )
    status = F.when(failed > 0, "error").otherwise(F.col("status"))
    good = compared.select(
        "source_id", F.col("audit_strategy").alias("strategy"), "expected_count", "ingested_count",
        "missing_urls", status.alias("status"), F.coalesce(partly, note).alias("detail"),
    )
    bad = bad.filter(F.col("n_good") == 0).join(facts, "source_id")
    detail = (
        F.when(F.col("kind") == "no-pattern", NO_PATTERN).when(F.col("kind") == "layout", NO_MATCH)
        .when(F.col("kind") == "http", F.format_string("the index page returned HTTP %d", F.col("http_status")))
        .when(F.col("kind") == "network", "the index page could not be fetched")
    )
    return good.unionByName(_error_rows(bad, F.coalesce(detail, F.col("kind"))))


def _error_rows(df: DataFrame, detail: Column) -> DataFrame:
    """Audits that could not run: an error with null counts, never a clean bill."""
    return df.select(
        "source_id",
        F.col("audit_strategy").alias("strategy"),
        F.lit(None).cast("long").alias("expected_count"),
        F.lit(None).cast("long").alias("ingested_count"),
        F.array().cast("array<string>").alias("missing_urls"),
        F.lit("error").alias("status"),
        detail.alias("detail"),
    )


def audit_proxy_sample(
    docs: DataFrame, sources: DataFrame, asof: Column, stored: int = MAX_STORED_MISSING
) -> DataFrame:
    """Audit by proxy: targets that a discovery source pointed at in the last day, against all held."""
    recent = fetched_since(docs, asof, "24 hours").filter(F.col("origin_discovery_target_url").isNotNull()).join(broadcast_if_small(sources.select("source_id")), "source_id", "left_semi")
    expected = with_canonical_url(
        recent.select("source_id", "origin_discovery_target_url", F.col("fetched_at").alias("pos")),
        "origin_discovery_target_url",
    )
    compared = compare_with_held(expected, docs, stored=stored)
    joined = sources.select("source_id", "audit_strategy").join(compared, "source_id", "left")
    filled = _verdict(
        joined.withColumn("expected_count", F.coalesce("expected_count", F.lit(0)))
        .withColumn("ingested_count", F.coalesce("ingested_count", F.lit(0)))
        .withColumn("missing_urls", F.coalesce("missing_urls", F.array().cast("array<string>")))
    )
    return filled.select(
        "source_id",
        F.col("audit_strategy").alias("strategy"),
        "expected_count",
        "ingested_count",
        "missing_urls",
        "status",
        F.when(F.col("expected_count") == 0, PROXY_EMPTY_NOTE).otherwise(PROXY_NOTE).alias("detail"),
    )


def run_audit(
    registry: DataFrame, harvested: DataFrame, docs: DataFrame, asof: Column, *, stored: int = MAX_STORED_MISSING
) -> DataFrame:
    """One audit row per auditable source, by its strategy. A source without an index is an error.

    A row lists ``stored`` missing URLs at most; ``missing_pages`` has all.
    ``harvested`` is read more than once here; pass a landed frame.
    """
    sources = auditable_sources(registry)
    proxy = sources.filter(F.col("audit_strategy") == "proxy_sample")
    diff = sources.filter(F.col("audit_strategy") != "proxy_sample")
    pages = harvested.join(broadcast_if_small(diff.select("source_id")), "source_id", "left_semi")
    by_index = audit_index_diff(pages, docs, diff, stored)
    absent = diff.join(pages.select("source_id").distinct(), "source_id", "left_anti")
    by_proxy = audit_proxy_sample(docs, proxy, asof, stored)
    rows = by_index.unionByName(_error_rows(absent, F.lit("index page was not landed"))).unionByName(by_proxy)
    return rows.join(sources.select("source_id", "vertical"), "source_id").withColumn(
        "audit_date", F.to_date(asof)
    )


def audit_summary(audits: DataFrame, vertical: str | None = None) -> DataFrame:
    """Audited, gaps, auditor failures; the gate passes only when both are zero."""
    rows = audits.filter(F.col("vertical") == vertical) if vertical else audits
    return rows.agg(
        F.count("*").alias("audited"),
        F.count_if(F.col("status") == "gap").alias("gaps"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("gate_passes"),
    )


def latest_audit(audits: DataFrame) -> DataFrame:
    """The most recent audit of each source."""
    return first_per_key(audits, ["source_id"], -F.unix_date("audit_date"))


def coverage_view(audits: DataFrame, registry: DataFrame, shown: int = MAX_SHOWN_MISSING) -> DataFrame:
    """Latest audits that need a look, gaps apart from auditor failures, with the list cut for display."""
    names = registry.select("source_id", "slug", "name")
    return (
        latest_audit(audits)
        .filter(F.col("status") != "ok")
        .join(broadcast_if_small(names), "source_id")
        .withColumn("shown_urls", F.slice("missing_urls", 1, shown))
        .withColumn("more_urls", F.greatest(F.size("missing_urls") - shown, F.lit(0)))
    )


def clean_streak(audits: DataFrame) -> DataFrame:
    """Runs of consecutive audit days without a gap or an error, per vertical.

    Audits fold to one row per vertical and day first, so the window sees days, not audits.
    """
    days = audits.groupBy("vertical", "audit_date").agg(
        F.bool_and(F.col("status") == "ok").alias("clean")
    )
    by_day = Window.partitionBy("vertical").orderBy("audit_date")
    islands = days.filter("clean").withColumn(
        "island", F.date_sub("audit_date", F.row_number().over(by_day))
    )
    return islands.groupBy("vertical", "island").agg(
        F.min("audit_date").alias("first_day"),
        F.max("audit_date").alias("last_day"),
        F.count("*").alias("clean_days"),
    ).drop("island")


def calendar_overdue(calendar: DataFrame, docs: DataFrame, asof: Column) -> DataFrame:
    """Due releases without a document of their source in the window from the due time on.

    ``calendar`` has ``source_id``, ``due_at`` and ``window_hours``. Due times and arrivals are swept together in order
    of time, and each due time sees the next arrival: one row each, however long the window.
    """
    due = calendar.filter(F.col("due_at") <= asof)
    named = [c for c in due.columns if c != "source_id"]
    arrivals = docs.filter(F.col("fetched_at").isNotNull()).select("source_id", F.col("fetched_at").alias("__at")).distinct()
    known = arrivals.join(broadcast_if_small(due.select("source_id").distinct()), "source_id", "left_semi")
    swept = due.select("source_id", F.col("due_at").alias("__at"), F.struct(*named).alias("__due")).unionByName(
        known, allowMissingColumns=True
    )
    found = next_event(swept, "source_id", "__at", F.col("__due").isNull(), "__arrived", strict=False)
    until = F.timestamp_micros(F.unix_micros("__due.due_at") + F.col("__due.window_hours") * 3_600_000_000)
    late = found.filter(F.col("__due").isNotNull() & (F.col("__arrived").isNull() | (F.col("__arrived") > until)))
    return late.select(*[F.col("source_id") if c == "source_id" else F.col("__due")[c].alias(c) for c in due.columns])
