"""Landed payloads to document rows, and the bookkeeping that comes with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.images import no_candidates, select_lead_image
from storyledger.functions.steps import pinned
from storyledger.functions.times import with_published
from storyledger.functions.urls import with_canonical_url
from storyledger.functions.wire import has_verbatim_quote, with_wire
from storyledger.limits import NO_LIMITS, Limits, left_chars
from storyledger.operators.identity import (
    dedup_within_pull,
    first_per_key,
    identify,
    mark_pages_to_fetch,
    not_held,
)
from storyledger.operators.pages import with_page_signals, with_page_text
from storyledger.operators.provenance import with_primary_links
from storyledger.schema import PRIMARY_DOMAIN_TYPES
from storyledger.session import landed
from storyledger.sizing import broadcast_if_small
from storyledger.sources.apis import (
    parsed_releases,
    parsed_stories,
    release_errors,
    release_items_of,
    story_error,
    story_items_of,
)
from storyledger.sources.feeds import atom_items, feed_error, feed_items, is_feed, parsed_feed, rss_items, with_url
from storyledger.sources.harvest import scrape_items, scrape_pages
from storyledger.sources.payloads import classify, error_message, usable
from storyledger.sources.registry import primary_hosts

ITEM_COLUMNS = (
    "pull_id", "source_id", "fetched_at", "pos", "url_raw", "title", "published_at_raw",
    "summary", "author", "image_candidates", "discovery_target_url",
)


FEEDS = ("rss", "atom")


def parse_payloads(payloads: DataFrame, registry: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """One landed row per payload with all that its body holds: ``feed``, ``reply``, ``releases`` or ``links``, and errors.

    The batch is read once and each body goes to the parser of its fetch type, once; items and errors are projections
    of the result. Unchanged payloads and payloads without a parser are not parsed.
    """
    good = classify(payloads).withColumnRenamed("error_kind", "base_kind")
    ok = F.col("payload_status") == "ok"

    def body_of(*fetch_types: str) -> Column:
        return F.when(ok & F.col("fetch_type").isin(*fetch_types), F.col("body"))

    split = good.select(
        *[c for c in good.columns if c != "body"],
        body_of(*FEEDS).alias("__feed"), body_of("hn").alias("__stories"), body_of("github_api").alias("__releases"),
        body_of("scrape").alias("body"),
    )
    harvested = scrape_pages(split, registry, max_links=limits.links_per_page)
    kept = [c for c in good.columns if c != "body"]
    parsed = pinned(
        harvested.withColumnRenamed("error_kind", "scrape_kind"),
        [*kept, "links", "scrape_kind"],
        {
            "feed": parsed_feed(F.col("__feed")),
            "reply": parsed_stories(F.col("__stories")),
            "story_kind": story_error(F.col("__stories")),
            "releases": parsed_releases(F.col("__releases")),
        },
    )
    return landed(parsed.withColumn("is_feed", is_feed(F.col("feed"))), "parsed")


def _parsed_as(parsed: DataFrame, *fetch_types: str) -> DataFrame:
    return parsed.filter((F.col("payload_status") == "ok") & F.col("fetch_type").isin(*fetch_types))


def items_of(parsed: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Item rows of parsed payloads."""
    parts = [
        with_url(feed_items(_parsed_as(parsed, *FEEDS))),
        story_items_of(_parsed_as(parsed, "hn")),
        release_items_of(_parsed_as(parsed, "github_api"), limits.summary_chars),
        scrape_items(_parsed_as(parsed, "scrape").withColumnRenamed("scrape_kind", "error_kind")),
    ]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part, allowMissingColumns=True)
    return items.select(*ITEM_COLUMNS)


def errors_of(parsed: DataFrame) -> DataFrame:
    """``pull_id``, ``source_id``, ``fetched_at``, ``http_status``, ``error_kind`` of bad pulls."""
    keys = ["pull_id", "source_id", "fetched_at", "http_status", "error_kind"]
    kind = (
        F.when(F.col("base_kind").isNotNull(), F.col("base_kind"))
        .when(F.col("payload_status") != "ok", F.lit(None).cast("string"))
        .when(F.col("fetch_type").isin(*FEEDS), feed_error(F.col("feed"), F.col("is_feed")))
        .when(F.col("fetch_type") == "hn", F.col("story_kind"))
        .when(F.col("fetch_type") == "scrape", F.col("scrape_kind"))
    )
    is_release = F.coalesce(F.col("fetch_type") == "github_api", F.lit(False))
    rows = parsed.filter(~is_release).withColumn("error_kind", kind).filter(F.col("error_kind").isNotNull())
    return rows.select(*keys).unionByName(release_errors(parsed.filter(is_release)).select(*keys))


def select_items(payloads: DataFrame, registry: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Item rows of all payloads: each fetch type goes to its parser, the rest to none."""
    return items_of(parse_payloads(payloads, registry, limits), limits)


def payload_errors(payloads: DataFrame, registry: DataFrame) -> DataFrame:
    """Bad pulls of all payloads, as :func:`errors_of`."""
    return errors_of(parse_payloads(payloads, registry))


def feed_rows(payloads: DataFrame, fetch_type: str) -> DataFrame:
    """Items of one feed type alone."""
    good = usable(classify(payloads), fetch_type)
    return with_url(rss_items(good) if fetch_type == "rss" else atom_items(good))


Held = DataFrame | Callable[[DataFrame], DataFrame]


def fresh_items(
    items: DataFrame, registry: DataFrame, held: Held, *, small_batch: bool = False, limits: Limits = NO_LIMITS
) -> DataFrame:
    """Items with an identity, the first per pull, not held yet, with ``fetch_page``.

    ``held`` may be a function that finds the stored URLs which given ones may meet.
    """
    facts = registry.select(
        "source_id", "vertical", "source_type", "source_role", "lowercase_url_path"
    )
    joined = items.join(broadcast_if_small(facts), "source_id")
    unique = dedup_within_pull(identify(joined, F.col("lowercase_url_path")))
    # Both the page marks and the result read this, and canonical URLs are the costly part.
    unique = landed(unique, "unique")
    known = held(unique.select("url")) if callable(held) else held
    fresh = not_held(unique, known, small_batch=small_batch)
    return mark_pages_to_fetch(fresh, F.col("source_role"), limits.pages_per_pull)


def latest_captures(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """``url``, ``page_status`` and ``page_body`` of the pages that ``asked`` (``url``) names.

    Page bodies are the bulk of the archive, so only those asked for are looked at further. Where ``pages`` has
    ``captured_at``, a URL may be in it any number of times and the latest capture counts; else it is in it once.
    """
    narrow = ["url", "page_status", "page_body"]
    if "captured_at" not in pages.columns:
        return pages.select(*narrow).join(asked, "url", "left_semi")
    found = pages.select(*narrow, "captured_at").join(asked, "url", "left_semi")
    return first_per_key(found, ["url"], -F.unix_micros("captured_at")).select(*narrow)


def build_documents(
    fresh: DataFrame, pages: DataFrame, registry: DataFrame, limits: Limits = NO_LIMITS
) -> DataFrame:
    """One document per fresh item, with its article page where one was landed.

    ``pages`` has ``url`` (canonical), ``page_status`` and ``page_body``, and ``captured_at`` if a URL can be in it more than
    once. The item's own title
    wins over the page's, the page's text over the item's summary, and feed images come before
    page images. A page that failed leaves a row with status ``failed``: that the article exists
    is the record. Items without a page to fetch are ``skipped``.
    """
    wanted = F.col("fetch_page")
    asked = fresh.filter(wanted).select("url").distinct()
    found = latest_captures(pages, asked)
    # Short rules first: every later step analyses the plan so far again.
    items = with_published(fresh)
    items = with_canonical_url(items, "discovery_target_url", out="origin_discovery_target_url")
    rows = items.join(found, "url", "left")
    page_ok = F.coalesce(
        wanted & F.col("page_status").between(200, 299) & (F.trim("page_body") != ""), F.lit(False)
    )
    rows = rows.withColumn("page_html", F.when(page_ok, F.col("page_body"))).withColumn(
        "page_problem",
        F.when(~wanted | page_ok, F.lit(None).cast("string"))
        .when(F.col("page_status").isNull(), F.concat(F.lit("request to "), F.col("url"), F.lit(" failed")))
        .when(
            ~F.col("page_status").between(200, 299),
            F.concat(F.col("url"), F.lit(" returned HTTP "), F.col("page_status").cast("string")),
        )
        .otherwise(F.concat(F.col("url"), F.lit(" returned an empty body"))),
    )
    rows = rows.drop("page_body")
    rows = with_page_text(with_page_signals(rows, "page_html", "url", limits), "page_html")
    rows = rows.withColumn(
        "page_host", F.regexp_extract("url", r"^https?://(?:[^/?#]*@)?([^/?#:]*)", 1)
    )
    rows = with_primary_links(
        rows, "hrefs", F.col("page_host"), primary_hosts(registry), key="url"
    )
    rows = with_wire(
        rows,
        byline=F.nullif(
            F.concat_ws(" · ", F.nullif("author", F.lit("")), F.col("page_byline")), F.lit("")
        ),
        body=F.col("page_text"),
        skip=F.col("source_type").isin(*PRIMARY_DOMAIN_TYPES) | F.col("page_html").isNull(),
    )
    has_page = F.col("page_html").isNotNull()
    candidates = F.concat(
        F.coalesce("image_candidates", no_candidates()), F.coalesce("page_images", no_candidates())
    )
    rows = rows.withColumn("candidates", candidates).withColumn(
        "image", select_lead_image("candidates", "url")
    )
    status = (
        F.when(F.col("page_problem").isNotNull(), "failed")
        .when(has_page, F.col("extraction_status"))
        .otherwise("skipped")
    )
    return rows.select(
        F.sha2("url", 256).alias("document_id"),
        "pull_id",
        "source_id",
        "vertical",
        "url",
        "url_raw",
        F.when(has_page, F.coalesce("title", "page_title")).otherwise(F.col("title")).alias("title"),
        F.when(has_page, F.coalesce("page_text", "summary"))
        .otherwise(F.col("summary"))
        .alias("text_content"),
        left_chars(F.col("page_html"), limits.snapshot_chars).alias("html_snapshot"),
        "fetched_at",
        "published_at",
        "published_at_confidence",
        "published_at_reason",
        status.alias("extraction_status"),
        F.coalesce("page_problem", F.when(has_page, F.col("extraction_error"))).alias("extraction_error"),
        F.coalesce("origin_primary_links", F.array().cast("array<string>")).alias("origin_primary_links"),
        F.col("wire_agency").alias("origin_wire_byline"),
        F.col("wire_evidence").alias("origin_wire_evidence"),
        has_verbatim_quote(F.col("quotes")).alias("origin_has_verbatim_quote"),
        "origin_discovery_target_url",
        F.col("image")["url"].alias("image_url"),
        F.col("image")["source"].alias("image_source"),
        F.col("image")["width"].alias("image_width"),
        F.col("image")["height"].alias("image_height"),
        F.lit(False).alias("is_processed"),
    )


def fetch_outcomes(
    payloads: DataFrame, items: DataFrame, documents: DataFrame, inserted: DataFrame, errors: DataFrame
) -> DataFrame:
    """One row per pull: what was seen, inserted and imaged, and the error if it failed.

    Images are counted over fresh documents, before conflicts with other pulls drop out.
    """
    pulls = payloads.groupBy("pull_id", "source_id", F.col("fetched_at").alias("attempted_at")).agg(
        F.max("http_status").alias("http_status"),
        F.max("etag").alias("etag"),
        F.max("last_modified").alias("last_modified"),
    )
    seen = items.groupBy("pull_id").agg(F.count("*").alias("items_seen"))
    fresh = documents.groupBy("pull_id").agg(F.count("image_url").alias("items_with_image"))
    new = inserted.groupBy("pull_id").agg(F.count("*").alias("items_new"))
    bad = errors.groupBy("pull_id").agg(F.min("error_kind").alias("error"))
    out = pulls
    for part in (seen, fresh, new, bad):
        out = out.join(part, "pull_id", "left")
    return out.select(
        "pull_id",
        "source_id",
        "attempted_at",
        "http_status",
        "etag",
        "last_modified",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("items_seen", "items_new", "items_with_image")],
        F.lit(0).alias("duration_ms"),
        "error",
    )


def error_rows(errors: DataFrame, registry: DataFrame) -> DataFrame:
    """Bad pulls with a message and the time, ready for the error table."""
    address = registry.select("source_id", F.col("feed_url").alias("__address"))
    joined = errors.join(broadcast_if_small(address), "source_id", "left")
    return joined.select(
        "source_id",
        "error_kind",
        error_message(F.col("error_kind"), F.coalesce("__address", "source_id"), F.col("http_status")).alias("message"),
        F.col("fetched_at").alias("attempted_at"),
    )


def ingest(
    parsed: DataFrame, pages: DataFrame, registry: DataFrame, held: Held, *,
    small_batch: bool = False, limits: Limits = NO_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """Parsed payloads to items, and to documents that are not held, before conflicts between pulls.

    Items, fresh items and documents are each read by more than one later step (page marks,
    inserts, outcome counts), so each is landed: payloads are parsed once, pages extracted once.
    """
    items = landed(items_of(parsed, limits), "items")
    fresh = landed(fresh_items(items, registry, held, small_batch=small_batch, limits=limits), "fresh")
    return items, landed(build_documents(fresh, pages, registry, limits), "documents")


def tick_summary(log: DataFrame, *by: str) -> DataFrame:
    """Per batch: sources polled, new documents, failed attempts."""
    return log.groupBy(*by).agg(
        F.count_distinct("source_id").alias("sources"),
        F.sum("items_new").alias("new_documents"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def feed_quality(items: DataFrame, errors: DataFrame, *, key: str = "source_id") -> DataFrame:
    """Per source: usable URLs, reliably dated items, items with a feed image, their sources, a sample.

    The source is in order when it has at least one usable URL.
    """
    dated = with_published(identify(items))
    imaged = dated.withColumn("image", select_lead_image("image_candidates", "url_raw"))
    found = imaged.groupBy(key).agg(
        F.count("url").alias("items"),
        F.count_if(F.col("published_at_confidence") == "high").alias("dated_items"),
        F.count("image").alias("imaged_items"),
        F.array_sort(F.collect_set(F.col("image")["source"])).alias("image_sources"),
        F.left(F.min_by("title", F.struct("pull_id", "pos")), F.lit(58)).alias("sample_title"),
    )
    failed = errors.groupBy(key).agg(F.min("error_kind").alias("error_kind"))
    both = found.join(failed, key, "full_outer")
    items_n = F.coalesce("items", F.lit(0))
    return both.select(
        key,
        (items_n > 0).alias("ok"),
        items_n.alias("items"),
        F.coalesce("dated_items", F.lit(0)).alias("dated_items"),
        F.coalesce("imaged_items", F.lit(0)).alias("imaged_items"),
        F.when(items_n > 0, F.floor(100 * F.coalesce("imaged_items", F.lit(0)) / items_n + 0.5)).alias("image_pct"),
        F.coalesce("image_sources", F.array().cast("array<string>")).alias("image_sources"),
        "sample_title",
        F.when(items_n == 0, F.coalesce("error_kind", F.lit("fetched but produced no usable URLs"))).alias("error"),
    )


def feed_quality_lists(quality: DataFrame, *, key: str = "source_id") -> DataFrame:
    """Sources to look at: failed, in order but imageless, in order but undated."""
    ok = F.col("ok")
    lists = F.array(
        F.when(~ok, F.lit("failed")),
        F.when(ok & (F.col("imaged_items") == 0), F.lit("imageless")),
        F.when(ok & (F.col("dated_items") == 0), F.lit("undated")),
    )
    return quality.select(key, F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("problem"))

