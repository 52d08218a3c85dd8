"""Every operator as a query over the benchmark tables.

A query takes the session and a folder of Parquet tables, and returns one frame. ``plain``
brings results into types that compare across engines: times as text, arrays joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyledger.catalog import bindings as B
from storyledger.functions import images, times
from storyledger.functions.claims import claim, corroboration
from storyledger.functions.html import without_invisible
from storyledger.functions.urls import with_budget_host, with_canonical_url
from storyledger.functions.wire import has_verbatim_quote, leading_words, with_wire
from storyledger.operators import audit, identity, merge, pages, provenance, schedule, validate
from storyledger.plans import bookkeeping, ingest, marts, rollups
from storyledger.limits import POLLER_LIMITS
from storyledger.schema import TABLES
from storyledger.session import landed, work_dir
from storyledger.sizing import broadcast_if_small
from storyledger.sources import apis, feeds, harvest, payloads, registry, tables
from storyledger.sources.store import Store
from storyledger.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text, whole numbers as bigint, arrays of text joined by '|'."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, "|")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# ---- URL identity --------------------------------------------------------------------


@query
def canonical_pages(spark, sf):
    known = with_canonical_url(B.table(spark, sf, "pages").select("url"), "url", out="key", host_out="host")
    return (
        known.filter(F.col("key").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n_pages"), F.count_distinct("key").alias("n_urls"))
    )


@query
def canonical_urls_rowwise(spark, sf):
    rows = B.table(spark, sf, "pages").select("page_id", "url")
    return with_canonical_url(rows, "url", out="canonical", host_out="host")


@query
def canonical_variants(spark, sf):
    """Options: keep the host prefix; lower-case the path by flag."""
    rows = B.pull_items(spark, sf).select("pos", "url_raw")
    kept = with_canonical_url(rows, "url_raw", out="with_prefix", keep_prefix=True)
    return with_canonical_url(kept, "url_raw", out="lowered", lowercase=F.col("pos") % 2 == 0).drop("url_raw")


def _items(spark, sf):
    return identity.identify(B.pull_items(spark, sf))


@query
def dedup_within_pull(spark, sf):
    return identity.dedup_within_pull(_items(spark, sf)).select("pull_id", "url", "pos", "url_raw")


@query
def url_quality(spark, sf):
    return identity.url_quality(_items(spark, sf), "pull_id")


@query
def host_budget(spark, sf):
    return with_budget_host(B.table(spark, sf, "pages").select("page_id", "url"), "url").select("page_id", "host")


def _held(spark, sf):
    index = with_canonical_url(B.page_index(spark, sf), "url_raw", out="url", host_out="source_id")
    return index, index.filter("is_held").select("url")


@query
def fresh_items(spark, sf):
    """Items of the pulls that are not held."""
    _, held = _held(spark, sf)
    return identity.not_held(identity.dedup_within_pull(_items(spark, sf)), held).select("pull_id", "url", "pos")


@query
def held_items(spark, sf):
    _, held = _held(spark, sf)
    return identity.held_only(identity.dedup_within_pull(_items(spark, sf)), held).select("pull_id", "url", "pos")


@query
def missing_items(spark, sf):
    """Index entries that are not held, in index order per source."""
    index, held = _held(spark, sf)
    first = index.groupBy("source_id", "url").agg(F.min("pos").alias("pos"))
    return identity.not_held(first, held)


@query
def fetch_page_set(spark, sf):
    """Which fresh items of a pull get their article page fetched."""
    _, held = _held(spark, sf)
    fresh = identity.not_held(identity.dedup_within_pull(_items(spark, sf)), held)
    role = F.when(F.col("pull_id") == "pull-4", "discovery").otherwise("record")
    return identity.mark_pages_to_fetch(fresh, role, POLLER_LIMITS.pages_per_pull).select("pull_id", "pos", "fetch_page")


# ---- registry ------------------------------------------------------------------------


@query
def registry_summary(spark, sf):
    return marts.registry_summary(B.registry(spark, sf))


@query
def registry_active(spark, sf):
    return marts.registry_active(B.registry(spark, sf))


@query
def registry_listing(spark, sf):
    return registry.registry_listing(B.registry(spark, sf))


@query
def registry_filter(spark, sf):
    known = B.registry(spark, sf)
    parts = [
        registry.registry_filter(known, s).select(F.lit(s or "default").alias("selector"), "slug")
        for s in (None, "finance", "tech", "src17")
    ]
    return validate.union_all(*parts)


@query
def auditable_sources(spark, sf):
    return registry.auditable_sources(B.registry(spark, sf)).select("slug", "audit_strategy")


@query
def duplicate_slugs(spark, sf):
    known = B.registry(spark, sf)
    again = known.filter("vertical = 'finance'").withColumn("name", F.concat("name", F.lit(" again")))
    return registry.duplicate_slugs(known.unionByName(again))


@query
def needs_section_feeds(spark, sf):
    return registry.needs_section_feeds(B.registry(spark, sf))


@query
def primary_hosts(spark, sf):
    return registry.primary_hosts(B.registry(spark, sf))


@query
def load_registry(spark, sf):
    """Terse registry rows, with the defaults filled in."""
    terse = B.registry(spark, sf).select(
        "slug", "name", "vertical", "source_type", "fetch_type", "feed_url",
        F.when(F.col("source_role") != "record", F.col("source_role")).alias("source_role"),
        F.when(F.col("active_start_hour") > 0, F.col("active_start_hour")).alias("active_start_hour"),
    )
    return registry.with_defaults(terse).select(
        "slug", "source_kind", "source_role", "audit_strategy", "active_hours_tz", "active_start_hour",
        "active_end_hour", "active_interval_min", "off_interval_min", "is_active", "topics", "notes",
        F.round(F.col("reliability_weight").cast("double"), 4).alias("reliability_weight"),
    )


# ---- marts ---------------------------------------------------------------------------


def _health(spark, sf):
    return marts.source_health(
        B.registry(spark, sf), B.raw_documents(spark, sf), B.fetch_log(spark, sf),
        B.source_errors(spark, sf), B.asof(),
    )


@query
def source_health(spark, sf):
    return _health(spark, sf).select(
        "slug", "name", "vertical", "last_fetched_at", "feed_window_size", "docs_24h", "docs_total",
        "image_pct_7d", "peak_new", "open_errors", "last_error",
    )


@query
def health_status(spark, sf):
    return marts.health_status(_health(spark, sf), B.asof()).select(
        "slug", "is_stale", "is_under_polled", "health", "last_fetch_age"
    )


@query
def totals(spark, sf):
    return marts.totals(B.registry(spark, sf), B.raw_documents(spark, sf), B.source_errors(spark, sf), B.asof())


def _rolled(spark, sf):
    """A store that documents and polls came into in three batches, with their hourly partial aggregates."""
    store = Store(f"{work_dir(spark, 'rollups')}/store")
    docs = B.raw_documents(spark, sf).withColumn("fetch_date", F.to_date("fetched_at"))
    log, none = B.fetch_log(spark, sf), spark.createDataFrame([], "url string")
    for version in range(3):
        mine, polls = docs.where(F.col("doc_id") % 3 == version), log.where(F.col("event_id") % 3 == version)
        added = {"raw_documents": mine, "fetch_log": polls, "document_hours": rollups.document_hours(mine), "log_hours": rollups.log_hours(polls)}
        store.commit(spark, version, none, added, {})
    return {name: store.read(spark, name, None, 2) for name in ("raw_documents", "fetch_log", "document_hours", "log_hours")}


@query
def source_health_rolled(spark, sf):
    """Source health from hourly partial aggregates of several batches."""
    t = _rolled(spark, sf)
    found = rollups.source_health(
        B.registry(spark, sf), t["document_hours"], t["log_hours"], t["raw_documents"], t["fetch_log"], B.source_errors(spark, sf), B.asof()
    )
    return found.select(
        "slug", "name", "vertical", "last_fetched_at", "feed_window_size", "docs_24h", "docs_total",
        "image_pct_7d", "peak_new", "open_errors", "last_error",
    )


@query
def totals_rolled(spark, sf):
    t = _rolled(spark, sf)
    return rollups.totals(B.registry(spark, sf), t["document_hours"], t["raw_documents"], B.source_errors(spark, sf), B.asof())


def _stored(spark, sf):
    return times.with_published(B.raw_documents(spark, sf))


@query
def recent_documents(spark, sf):
    return marts.recent_documents(_stored(spark, sf), B.registry(spark, sf), 120)


FEED = (
    "url", "title", "vertical", "source_name", "published_at", "published_at_confidence",
    "fetched_at", "image_url", "origin_wire_byline", "origin_primary_links", "snippet", "card_text",
    "claim_type", "date_is_approximate", "age",
)


@query
def feed_all(spark, sf):
    return marts.feed(_stored(spark, sf), B.registry(spark, sf), B.asof()).select(*FEED)


@query
def feed_finance(spark, sf):
    return marts.feed(_stored(spark, sf), B.registry(spark, sf), B.asof(), "finance").select(*FEED)


# ---- provenance ----------------------------------------------------------------------


def _wired(spark, sf):
    rows = B.raw_documents(spark, sf).select("doc_id", "source_id", "story_key", "text_content")
    return with_wire(rows, byline=F.lit(None).cast("string"), body=F.col("text_content"))


def _facts(spark, sf):
    return broadcast_if_small(B.source_facts(spark, sf))


@query
def wire_detect(spark, sf):
    return _wired(spark, sf).select("doc_id", "wire_agency", "wire_evidence", "wire_matched")


@query
def wire_mix(spark, sf):
    return provenance.mix(_wired(spark, sf), "source_id", "wire_agency", "wire_evidence")


@query
def corroboration_flags(spark, sf):
    rows = _wired(spark, sf).join(_facts(spark, sf), "source_id")
    verdict = corroboration(F.col("source_role"), F.col("wire_agency"), F.col("wire_evidence"))
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.counts", "v.counts_reason")


@query
def independent_sources(spark, sf):
    return provenance.independent_sources(_wired(spark, sf).join(_facts(spark, sf), "source_id"), "story_key")


def _claims(spark, sf):
    rows = B.raw_documents(spark, sf).select("doc_id", "source_id", "text_content").join(_facts(spark, sf), "source_id")
    verdict = claim(F.col("source_role"), F.col("source_type"), F.col("text_content"))
    return rows.select("doc_id", "source_id", verdict.alias("v")).select("doc_id", "source_id", "v.claim_type", "v.claim_reason")


@query
def claim_types(spark, sf):
    return _claims(spark, sf).select("doc_id", "claim_type", "claim_reason")


@query
def claim_mix(spark, sf):
    return provenance.mix_pivot(
        _claims(spark, sf), "source_id", "claim_type", ["announced", "reported", "rumoured", "speculated"]
    )


def _timed(spark, sf):
    rows = B.raw_documents(spark, sf).select("doc_id", "source_id", "published_at_raw", "fetched_at")
    return times.with_published(rows)


@query
def published_confidence(spark, sf):
    return _timed(spark, sf).select("doc_id", "published_at", "published_at_confidence", "published_at_reason")


@query
def confidence_mix(spark, sf):
    rows = _timed(spark, sf).withColumn("reliable", times.is_timestamp_reliable(F.col("published_at_confidence")))
    return provenance.mix(rows, "source_id", "published_at_confidence", "reliable")


@query
def primary_links(spark, sf):
    rows = provenance.with_primary_links(
        B.page_links(spark, sf), "hrefs", F.col("page_host"), registry.primary_hosts(B.registry(spark, sf)), key="page_id"
    )
    return rows.select("page_id", F.col("origin_primary_links").alias("primary_links"))


# ---- schedule ------------------------------------------------------------------------


@query
def due_sources(spark, sf):
    return schedule.due_sources(B.registry(spark, sf), B.asof(), 8).select("slug", "next_fetch_at")


CALENDAR = ("active_hours_tz", "active_start_hour", "active_end_hour")


def _calendars(spark, sf):
    known = B.registry(spark, sf).withColumn("active_hours_tz", times.known_zone(F.col("active_hours_tz")))
    return broadcast_if_small(known.select("source_id", *CALENDAR, "active_interval_min", "off_interval_min"))


@query
def active_hours(spark, sf):
    """Share of polls that fell into the active hours of their source."""
    rows = B.fetch_log(spark, sf).select("source_id", "attempted_at").join(_calendars(spark, sf), "source_id")
    active = times.is_active_hour(F.col("attempted_at"), *[F.col(c) for c in CALENDAR])
    return rows.groupBy("source_id").agg(F.count_if(active).alias("in_hours"), F.count("*").alias("polls"))


@query
def next_fetch(spark, sf):
    rows = B.fetch_log(spark, sf).select("event_id", "source_id", "attempted_at").join(_calendars(spark, sf), "source_id")
    at = times.next_fetch_at(
        F.col("attempted_at"), *[F.col(c) for c in CALENDAR], F.col("active_interval_min"), F.col("off_interval_min")
    )
    return rows.select("event_id", at.alias("next_at"))


@query
def throttle_backoff(spark, sf):
    return schedule.throttle_state(B.fetch_log(spark, sf))


@query
def throttle_history(spark, sf):
    rows = B.fetch_log(spark, sf).select("event_id", "host", "attempted_at", "http_status", "error")
    return schedule.throttle_history(rows, "host", "event_id").select("event_id", "host", "throttles", "backoff_ms")


def _attempts(spark, sf):
    log = B.fetch_log(spark, sf)
    last = schedule.latest_attempts(
        log.select("source_id", "event_id", "attempted_at", "http_status", "error", "items_seen", "host"), "event_id"
    )
    states = schedule.throttle_state(log).select("host", "backoff_ms")
    throttled = F.col("http_status").isin(*payloads.THROTTLE_STATUSES)
    return last.join(states, "host").select(
        "source_id", "attempted_at", "http_status", "error", "items_seen",
        F.when(throttled, F.col("backoff_ms")).otherwise(F.lit(0)).alias("backoff_ms"),
        F.when(F.col("error").isNull(), F.concat(F.lit("seen-"), F.col("event_id").cast("string"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


@query
def advance_schedule(spark, sf):
    return schedule.advance_schedule(B.registry(spark, sf), _attempts(spark, sf)).select(
        "slug", "next_fetch_at", "last_fetched_at", "last_etag", "last_modified", "feed_window_size"
    )


# ---- merges --------------------------------------------------------------------------


@query
def insert_if_absent(spark, sf):
    """Rows to append when all pulls meet the held pages."""
    _, held = _held(spark, sf)
    new = _items(spark, sf).filter(F.col("url").isNotNull())
    return merge.insert_if_absent(new, held, "pull_id", "pos").select("url", "pull_id", "pos")


@query
def upsert_registry(spark, sf):
    """Re-seeding: finance rows come with new settings, tech rows are absent, one row is new."""
    current = B.registry(spark, sf)
    seed = (
        current.filter("vertical = 'finance'")
        .withColumn("name", F.concat("name", F.lit(" (new)")))
        .withColumn("notes", F.lit(None).cast("string"))
        .withColumn("last_etag", F.lit("reset"))
        .withColumn("slug", F.when(F.col("slug") == "src5", F.lit("src5-new")).otherwise(F.col("slug")))
    )
    return merge.upsert_registry(current, seed, B.asof()).select(
        "slug", "name", "notes", "last_etag", "vertical", "next_fetch_at", "updated_at"
    )


def _audits(spark, sf):
    """Audits per host and day over the page index, the first run of each."""
    index, held = _held(spark, sf)
    keyed = index.withColumn("k", F.concat_ws(" ", "source_id", F.col("audit_date").cast("string")))
    compared = audit.compare_with_held(keyed, held, key="k")
    host = F.split("k", " ")
    rows = compared.select(
        host[0].alias("source_id"),
        F.when(F.length(host[0]) % 2 == 0, "finance").otherwise("tech").alias("vertical"),
        host[1].cast("date").alias("audit_date"),
        F.lit("index_diff").alias("strategy"),
        "expected_count", "ingested_count", "missing_urls",
        F.when(F.col("expected_count") > F.col("ingested_count"), "gap").otherwise("ok").alias("status"),
    )
    broken = F.col("source_id").rlike("^(spam|ads|casino)")
    return rows.select(
        "source_id", "vertical", "audit_date", "strategy",
        F.when(~broken, F.col("expected_count")).alias("expected_count"),
        F.when(~broken, F.col("ingested_count")).alias("ingested_count"),
        F.when(~broken, F.col("missing_urls")).otherwise(F.array().cast("array<string>")).alias("missing_urls"),
        F.when(broken, "error").otherwise(F.col("status")).alias("status"),
        F.when(broken, "index matched no links").alias("detail"),
    )


def _merged_audits(spark, sf):
    """The first run, with the .org hosts audited again after everything was fetched."""
    first = _audits(spark, sf)
    second = first.filter("source_id LIKE '%.org'").select(
        "source_id", "vertical", "audit_date", "strategy", "expected_count",
        F.col("expected_count").alias("ingested_count"),
        F.array().cast("array<string>").alias("missing_urls"),
        F.lit("ok").alias("status"), F.lit("second run").alias("detail"), F.lit(1).alias("run_no"),
    )
    return merge.upsert_audit(first, second)


@query
def index_diff_by_host(spark, sf):
    return _audits(spark, sf)


@query
def upsert_audit(spark, sf):
    return _merged_audits(spark, sf)


@query
def latest_audit(spark, sf):
    return audit.latest_audit(_merged_audits(spark, sf))


@query
def coverage_view(spark, sf):
    audits = _merged_audits(spark, sf)
    names = audits.select("source_id").distinct().select(
        "source_id", F.col("source_id").alias("slug"), F.upper("source_id").alias("name")
    )
    return audit.coverage_view(audits, names, shown=1).select(
        "slug", "name", "audit_date", "status", "shown_urls", "more_urls"
    )


@query
def clean_streak(spark, sf):
    return audit.clean_streak(_merged_audits(spark, sf))


@query
def audit_summary(spark, sf):
    audits = _merged_audits(spark, sf)
    return validate.union_all(
        audit.audit_summary(audits).withColumn("scope", F.lit("all")),
        audit.audit_summary(audits, "finance").withColumn("scope", F.lit("finance")),
    )


@query
def resolve_errors(spark, sf):
    return B.source_errors(spark, sf)


@query
def fetch_log_rows(spark, sf):
    return merge.fetch_log_rows(B.fetch_log(spark, sf))


@query
def source_error_rows(spark, sf):
    failed = B.fetch_log(spark, sf).select(
        "source_id", F.col("error").alias("error_kind"), "attempted_at",
        payloads.error_message(F.col("error"), F.col("host"), F.col("http_status")).alias("message"),
    )
    return merge.source_error_rows(failed)


@query
def purge_stale_urls(spark, sf):
    return merge.purge_stale_urls(
        B.raw_documents(spark, sf).select("source_id", "url"), B.registry(spark, sf)
    )


@query
def retention(spark, sf):
    kept = merge.apply_retention(B.raw_documents(spark, sf), B.asof())
    return kept.select("url", "text_content", "html_snapshot")


@query
def retention_counts(spark, sf):
    return merge.retention_counts(B.raw_documents(spark, sf), B.asof())


@query
def retention_debt(spark, sf):
    docs = B.raw_documents(spark, sf)
    return validate.union_all(
        merge.retention_debt(docs, B.asof()).withColumn("state", F.lit("before")),
        merge.retention_debt(merge.apply_retention(docs, B.asof()), B.asof()).withColumn("state", F.lit("after")),
    )


# ---- audits over harvested index pages -----------------------------------------------


def _harvested(spark, sf):
    found = harvest.scrape_pages(B.index_payloads(spark, sf), B.registry(spark, sf), max_links=POLLER_LIMITS.links_per_page)
    return landed(found.select("source_id", "pull_id", "links", "error_kind"), "harvested")


AUDIT = ("source_id", "strategy", "expected_count", "ingested_count", "missing_urls", "status", "detail")


@query
def audit_index_diff(spark, sf):
    known = registry.auditable_sources(B.registry(spark, sf)).filter("audit_strategy <> 'proxy_sample'")
    pages_ = _harvested(spark, sf).join(broadcast_if_small(known.select("source_id")), "source_id", "left_semi")
    return audit.audit_index_diff(pages_, B.raw_documents(spark, sf), known).select(*AUDIT)


@query
def audit_proxy_sample(spark, sf):
    known = registry.auditable_sources(B.registry(spark, sf)).filter("audit_strategy = 'proxy_sample'")
    return audit.audit_proxy_sample(B.raw_documents(spark, sf), known, B.asof()).select(*AUDIT)


@query
def audit_run(spark, sf):
    rows = audit.run_audit(B.registry(spark, sf), _harvested(spark, sf), B.raw_documents(spark, sf), B.asof())
    return rows.select(*AUDIT, "vertical", "audit_date")


@query
def calendar_overdue(spark, sf):
    """Releases due at each source daily at noon, with a window of two hours."""
    days = B.raw_documents(spark, sf).select(
        "source_id", F.timestamp_micros(F.unix_micros(F.date_trunc("day", "fetched_at")) + 43_200_000_000).alias("due_at")
    ).distinct()
    return audit.calendar_overdue(days.withColumn("window_hours", F.lit(2)), B.raw_documents(spark, sf), B.asof())


@query
def harvest_links(spark, sf):
    """Navigation links of the crawled pages; titles may be short here."""
    rows = B.table(spark, sf, "pages").select("page_id", "url", "html")
    found = harvest.harvest_links(rows, "html", "url", min_title_chars=1, max_links=POLLER_LIMITS.links_per_page)
    return found.select("page_id", F.posexplode("links").alias("at", "link")).select(
        "page_id", "at", F.col("link")["url"].alias("link_url"), F.col("link")["title"].alias("title")
    )


# ---- payloads ------------------------------------------------------------------------

ITEM = ("pull_id", "pos", "url_raw", "title", "published_at_raw", "summary", "author")


@query
def rss_items(spark, sf):
    return ingest.feed_rows(B.payloads(spark, sf), "rss").select(*ITEM)


@query
def atom_items(spark, sf):
    return ingest.feed_rows(B.payloads(spark, sf), "atom").select(*ITEM)


@query
def hn_items(spark, sf):
    good = payloads.usable(payloads.classify(B.payloads(spark, sf)), "hn")
    return apis.story_items(good).select(*ITEM, "discovery_target_url")


@query
def release_items(spark, sf):
    good = payloads.usable(payloads.classify(B.payloads(spark, sf)), "github_api")
    return apis.release_items(good, POLLER_LIMITS.summary_chars).select(*ITEM)


@query
def scrape_items(spark, sf):
    good = payloads.usable(payloads.classify(B.payloads(spark, sf)), "scrape")
    return harvest.scrape_items(harvest.scrape_pages(good, B.registry(spark, sf), max_links=POLLER_LIMITS.links_per_page)).select("pull_id", "pos", "url_raw", "title")


@query
def payload_errors(spark, sf):
    return ingest.payload_errors(B.payloads(spark, sf), B.registry(spark, sf)).select("pull_id", "http_status", "error_kind")


@query
def payload_status(spark, sf):
    return provenance.mix(payloads.classify(B.payloads(spark, sf)), "fetch_type", "payload_status", "error_kind")


@query
def select_adapter(spark, sf):
    """Items per pull, each fetch type through its own parser."""
    items = ingest.select_items(B.payloads(spark, sf), B.registry(spark, sf), POLLER_LIMITS)
    return items.groupBy("pull_id").agg(F.count("*").alias("n_items"), F.count("discovery_target_url").alias("n_targets"))


@query
def feed_candidates(spark, sf):
    """Image candidates of feed items, in order."""
    good = payloads.usable(payloads.classify(B.payloads(spark, sf)), "rss")
    items = feeds.with_url(feeds.rss_items(good))
    return items.select("pull_id", "pos", F.posexplode("image_candidates").alias("at", "c")).select(
        "pull_id", "pos", "at", F.col("c")["url"].alias("image"), F.col("c")["source"].alias("source"),
        F.col("c")["width"].alias("width"),
    )


def _quality(spark, sf):
    batch, known = landed(B.payloads(spark, sf), "payloads"), B.registry(spark, sf)
    parsed = ingest.parse_payloads(batch, known, POLLER_LIMITS)
    return ingest.feed_quality(ingest.items_of(parsed, POLLER_LIMITS), ingest.errors_of(parsed))


@query
def feed_quality(spark, sf):
    return _quality(spark, sf)


@query
def feed_quality_lists(spark, sf):
    return ingest.feed_quality_lists(_quality(spark, sf))


def _ingested(spark, sf):
    """A batch of payloads against a store that holds the documents in German."""
    batch, known = landed(B.payloads(spark, sf), "payloads"), B.registry(spark, sf)
    held = B.table(spark, sf, "documents").filter("lang = 'de'").select(
        F.expr("concat('https://', source, '.example.com/A/', doc_id)").alias("url")
    )
    parsed = ingest.parse_payloads(batch, known, POLLER_LIMITS)
    items, documents = ingest.ingest(parsed, B.landed_pages(spark, sf), known, held, limits=POLLER_LIMITS)
    return batch, parsed, items, held, documents


@query
def build_documents(spark, sf):
    *_, documents = _ingested(spark, sf)
    return documents.drop("html_snapshot")


@query
def fetch_outcome(spark, sf):
    batch, parsed, items, held, documents = _ingested(spark, sf)
    new = documents.select("url", "pull_id", "source_id")
    inserted = merge.insert_if_absent(new, held, "source_id", "pull_id")
    errors = ingest.errors_of(parsed)
    return ingest.fetch_outcomes(batch, items, documents, inserted, errors).select(
        "pull_id", "source_id", "attempted_at", "http_status", "etag", "items_seen", "items_new", "items_with_image", "error"
    )


BATCHES = 3


def _settled(spark, sf):
    """A store after the payloads have streamed into it in batches of consecutive times."""
    work = work_dir(spark, "bookkeeping")
    batch, known = landed(B.payloads(spark, sf), "payloads"), B.registry(spark, sf)
    held = B.table(spark, sf, "documents").filter("lang = 'de'").select(
        F.expr("concat('https://', source, '.example.com/A/', doc_id)").alias("url")
    )
    store = Store(f"{work}/store", n=16)
    bookkeeping.found(spark, store, known, held)
    slot = F.floor((F.unix_micros(B.asof()) - F.unix_micros("fetched_at")) / 288_000_000_000)
    # The stream runs whenever payloads have landed, and takes all files that are new as one batch.
    for i in reversed(range(BATCHES)):
        part = batch.where(slot == i) if i else batch.where(slot <= 0)
        part.write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{work}/in")
        jobs.stream_bookkeeping(stream, store, B.landed_pages(spark, sf), work, POLLER_LIMITS).awaitTermination()
    return store, store.latest(spark)


def _ddl(name):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name])


def _told(column):
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def _moment(column):
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


@query
def ingest_bookkeeping(spark, sf):
    """Every table after all batches: new documents, the log, closed and open errors, the next registry."""
    store, version = _settled(spark, sf)

    def rows(frame, name, key, at, *detail):
        return frame.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), F.col(at).alias("at"), F.concat_ws("|", *detail).alias("detail"))

    error = ("source_id", "occurred_at", "error_type", "message", _moment("resolved_at"))
    counts = [_told(c) for c in ("http_status", "items_seen", "items_new", "items_with_image", "error")]
    state = (_moment("last_fetched_at"), "last_etag", _told("feed_window_size"))
    return validate.union_all(
        rows(store.read(spark, "raw_documents", None, version), "raw_documents", "url", "fetched_at", "pull_id", "extraction_status"),
        rows(store.read(spark, "fetch_log", None, version), "fetch_log", "source_id", "attempted_at", *counts),
        rows(store.read(spark, "source_errors", None, version), "closed_errors", *error),
        rows(store.read_whole(spark, "open_errors", version), "open_errors", *error),
        rows(store.read_whole(spark, "sources", version), "sources", "slug", "next_fetch_at", *state),
    )


@query
def scan_tables(spark, sf):
    """The stored tables read back with their declared schemas; documents of the last days, by folders of dates."""
    store, version = _settled(spark, sf)
    docs = tables.fetched_since(store.read(spark, "raw_documents", _ddl("raw_documents"), version), B.asof(), "5 days")
    log = store.read(spark, "fetch_log", _ddl("fetch_log"), version)
    parts = [
        docs.groupBy(F.col("vertical").alias("of"), F.lit("raw_documents").alias("table_name")).agg(
            F.count("*").alias("n"), F.count_distinct("document_id").alias("n_keys"), F.count("pull_id").alias("n_pulls")
        ),
        log.groupBy(F.coalesce("error", F.lit("-")).alias("of"), F.lit("fetch_log").alias("table_name")).agg(
            F.count("*").alias("n"), F.count_distinct("source_id").alias("n_keys"), F.sum("items_new").alias("n_pulls")
        ),
    ]
    return validate.union_all(*parts)


@query
def tick_summary(spark, sf):
    """Polls per day as batches."""
    log = B.fetch_log(spark, sf).withColumn("day", F.to_date("attempted_at"))
    return ingest.tick_summary(log, "day")


# ---- images and pages ----------------------------------------------------------------


def _images(spark, sf):
    rows = B.image_candidates(spark, sf)
    return rows.withColumn("image", images.select_lead_image("candidates", "page_url"))


@query
def lead_image(spark, sf):
    return _images(spark, sf).select("doc_id", "image.url", "image.source", "image.width", "image.height")


@query
def image_mix(spark, sf):
    rows = _images(spark, sf).select("source_id", F.col("image")["source"].alias("image_source"))
    return provenance.mix_pivot(
        rows, "source_id", "image_source", ["media_content", "media_thumbnail", "enclosure", "content_img", "og", "twitter", "inline"]
    )


@query
def first_img(spark, sf):
    rows = B.marked_pages(spark, sf)
    return rows.select("page_id", images.first_image_in_html(F.col("html")).alias("first_img"))


@query
def page_candidates(spark, sf):
    rows = B.marked_pages(spark, sf).select("page_id", F.posexplode(images.page_candidates(without_invisible(F.col("html")), POLLER_LIMITS.page_images)).alias("at", "c"))
    return rows.select("page_id", "at", "c.url", "c.source", "c.width", "c.height")


@query
def page_signals(spark, sf):
    rows = pages.with_page_signals(B.marked_pages(spark, sf), limits=POLLER_LIMITS)
    return rows.select(
        "page_id", "page_byline", "page_title", F.size("hrefs").alias("n_links"), "hrefs",
        has_verbatim_quote(F.col("quotes")).alias("has_verbatim_quote"),
    )


@query
def plain_text(spark, sf):
    rows = B.table(spark, sf, "pages")
    return rows.select("page_id", pages.plain_text(F.col("html")).alias("plain_text"))


@query
def article_text(spark, sf):
    rows = B.table(spark, sf, "pages")
    return rows.select("page_id", pages.article_text(F.col("html")).alias("article_text"))


@query
def extraction_status(spark, sf):
    rows = pages.with_page_text(B.table(spark, sf, "pages"))
    return rows.select("page_id", F.char_length("page_text").alias("n_chars"), "extraction_status", "extraction_error")


@query
def extraction_mix(spark, sf):
    return provenance.mix(B.raw_documents(spark, sf), "source_id", "extraction_status")


@query
def page_wire(spark, sf):
    """Wire agency of a page: its bylines first, then its text."""
    rows = pages.with_page_text(pages.with_page_signals(B.marked_pages(spark, sf), limits=POLLER_LIMITS))
    text = F.col("page_text")
    wired = with_wire(rows, byline=F.col("page_byline"), body=text, head=leading_words(text))
    return wired.select("page_id", "wire_agency", "wire_evidence", "wire_matched")


# ---- validation ----------------------------------------------------------------------


@query
def enum_violations(spark, sf):
    """Domains of registry and documents, with the benchmark's own language column as a stray status."""
    docs = B.raw_documents(spark, sf).join(
        B.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"
    ).withColumn("extraction_status", F.when(F.col("lang") == "en", F.col("extraction_status")).otherwise(F.col("lang")))
    return validate.union_all(
        validate.enum_violations(B.registry(spark, sf), "sources"),
        validate.enum_violations(docs, "raw_documents"),
        validate.enum_violations(_merged_audits(spark, sf), "coverage_audit"),
    )


@query
def orphans(spark, sf):
    """Facts whose source the registry lacks: tech sources are left out of it here."""
    known = B.registry(spark, sf).filter("vertical = 'finance'")
    return validate.union_all(
        validate.orphans(B.raw_documents(spark, sf), known, "raw_documents"),
        validate.orphans(B.fetch_log(spark, sf), known, "fetch_log"),
        validate.orphans(B.source_errors(spark, sf), known, "source_errors"),
    )


@query
def unique_violations(spark, sf):
    index, _ = _held(spark, sf)
    return validate.union_all(
        validate.unique_violations(B.registry(spark, sf), "sources"),
        validate.unique_violations(index, "raw_documents"),
        validate.unique_violations(_audits(spark, sf).unionByName(_audits(spark, sf)), "coverage_audit"),
    )


# ---- streams -------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A benchmark table as a file stream, whether it is one file or a folder of files."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # A pattern, since a stream takes a plain path for a folder, and a filter on names would look at the files inside.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query
def stream_ingest(spark, sf):
    """Pages as a stream into the document store, each canonical URL once."""
    work = work_dir(spark, "stream-ingest")
    store = Store(f"{work}/store")

    def build(batch: DataFrame) -> DataFrame:
        rows = batch.select(
            "page_id", F.col("url").alias("url_raw"),
            F.timestamp_micros(F.unix_micros(B.asof()) - F.col("page_id") * 60_000_000).alias("fetched_at"),
        )
        known = with_canonical_url(rows, "url_raw", out="url", host_out="source_id")
        return known.filter(F.col("url").isNotNull())

    jobs.stream_ingest(_stream(spark, sf, "pages"), store, work, build, ("page_id",)).awaitTermination()
    return store.read(spark, "raw_documents", None, store.latest(spark)).select("url", "source_id", "page_id")


@query
def stream_dedup(spark, sf):
    work = work_dir(spark, "stream-dedup")
    rows = _stream(spark, sf, "pages").select(
        F.col("url").alias("url_raw"),
        F.timestamp_micros(F.unix_micros(B.asof()) + F.col("page_id") * 1_000_000).alias("fetched_at"),
    )
    store = Store(f"{work}/store")
    jobs.dedup_into_store(rows, "url_raw", store, work).awaitTermination()
    return store.read(spark, "raw_documents", None, store.latest(spark)).select("url")


@query
def stream_fetch_health(spark, sf):
    work = work_dir(spark, "stream-health")
    log = _stream(spark, sf, "events").select(
        F.expr("concat('src', user_id % 20)").alias("source_id"),
        F.col("ts").cast("timestamp").alias("attempted_at"),
        F.expr("CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(floor(value) AS INT) % 40 % 31 END").alias("items_new"),
        F.expr("CASE WHEN event_type = 'error' THEN 'http' END").alias("error"),
    )
    return jobs.fetch_health_table(log, f"{work}/out", work)
