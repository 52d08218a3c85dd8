"""Candidate article links of an index page."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.html import attr, elements, opening_tag, text_of, without_invisible
from storyledger.functions.images import no_candidates
from storyledger.functions.steps import Stage, add_steps, map_steps, pinned
from storyledger.functions.text import web_trim
from storyledger.functions.urls import base_parts, parse_stages, resolve_stages
from storyledger.sizing import broadcast_if_small
from storyledger.sources.feeds import PULL_COLUMNS

# Shortest article title, and paths that are never articles.
MIN_TITLE_CHARS = 25
CHROME = r"(?i)/(?:login|signin|register|about|contact|privacy|terms|disclaimer|sitemap|search|feedback|help|faq)(?:/|$|\.)|\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|zip)(?:$|\?)"  # noqa: E501
NOT_A_PAGE = r"(?i)^(?:#|(?:mailto|javascript|tel|data):)"


def _first(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _same_site(a: Column, b: Column) -> Column:
    return (
        (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    )


def harvest_links(
    pages: DataFrame,
    html_col: str = "body",
    page_url_col: str = "page_url",
    *,
    pattern: Column | None = None,
    min_title_chars: int = MIN_TITLE_CHARS,
    max_links: int | None = None,
) -> DataFrame:
    """Add ``links``: an array of ``url`` and ``title`` in page order, and ``page_ok``.

    A page is one row, so its links are filtered and made unique inside the row: no shuffle.
    ``pattern`` is matched against the resolved, not the canonical, URL; a null one matches all.
    """
    known = add_steps(
        pages, _page_stages(), {"page": F.col(page_url_col)}, {"clean": "__page", "site": "__site"}
    )
    staged = known.select(
        "*",
        base_parts(F.col("__page")).alias("__base"),
        elements(without_invisible(F.col(html_col)), "a").alias("__anchors"),
        (pattern if pattern is not None else F.lit(None).cast("string")).alias("__pattern"),
    )
    staged = staged.select(
        "*", _candidates().alias("__named")
    ).withColumn("__candidates", F.filter("__named", lambda a: F.char_length(a["title"]) >= min_title_chars))
    staged = staged.withColumn("__kept", _kept_links())
    staged = staged.withColumn("__all", F.transform("__kept", lambda a: a["url"]))
    staged = staged.withColumn("__urls", _first(F.array_distinct("__all"), max_links))
    links = F.transform(
        "__urls",
        lambda u: F.struct(
            u.alias("url"),
            F.element_at(F.col("__kept"), F.array_position(F.col("__all"), u).cast("int"))["title"].alias("title"),
        ),
    )
    none = F.array().cast("array<struct<url:string,title:string>>")
    found = {"page_ok": F.col("__page").isNotNull(), "links": F.coalesce(links, none)}
    return pinned(staged, pages.columns, found)


@lru_cache
def _page_stages() -> tuple[Stage, ...]:
    """The page's own URL, checked and normalised."""
    return (
        {"raw": lambda g: web_trim(g("page"))},
        *parse_stages("raw"),
        {
            "clean": lambda g: F.when(
                g("ok"),
                F.concat(g("scheme"), F.lit("://"), g("user"), g("host"), g("port"), g("path"), g("query")),
            ),
            "site": lambda g: F.when(g("ok"), _bare(g("host"))),
        },
    )


@lru_cache
def _candidates() -> Column:
    """Anchors that may lead to a page, with their text."""
    anchors = F.transform(
        F.col("__anchors"),
        lambda e: F.struct(
            web_trim(attr(opening_tag(e), "href")).alias("href"), text_of(e).alias("title")
        ),
    )
    return F.filter(
        anchors, lambda a: (F.coalesce(a["href"], F.lit("")) != "") & ~a["href"].rlike(NOT_A_PAGE)
    )


@lru_cache
def _kept_links() -> Column:
    """Candidates resolved against the page that stay on its site, off its chrome, and match."""
    start = F.transform(
        F.col("__candidates"),
        lambda a: F.struct(a["href"].alias("href"), a["title"].alias("title"), F.col("__base").alias("base")),
    )
    resolved = map_steps(start, ["href", "title", "base"], resolve_stages("href", "base"))
    slim = F.transform(
        resolved,
        lambda a: F.struct(
            a["resolved"].alias("url"), a["title"].alias("title"), a["path"].alias("path"),
            _bare(a["host"]).alias("site"),
        ),
    )
    return F.filter(
        slim,
        lambda a: a["url"].isNotNull()
        & _same_site(a["site"], F.col("__site"))
        & ~a["path"].rlike(CHROME)
        & (F.col("__pattern").isNull() | F.regexp_like(a["url"], F.col("__pattern"))),
    )


def scrape_pages(payloads: DataFrame, registry: DataFrame, **options: int | None) -> DataFrame:
    """Index payloads with their links and ``error_kind``.

    The registry row supplies the mandatory pattern. Without one the page is refused
    (``no-pattern``); a page that matches nothing has changed shape (``layout``). Where payloads have an
    ``http_status``, a page that was not delivered is ``network`` or ``http``, and its body is not looked at.
    """
    facts = registry.select(
        "source_id", F.coalesce("index_url", "feed_url").alias("page_url")
        if "page_url" not in payloads.columns
        else F.lit(None).alias("__none"),
        F.nullif(F.col("index_link_pattern"), F.lit("")).alias("link_pattern"),
    )
    joined = payloads.join(broadcast_if_small(facts), "source_id", "left").drop("__none")
    undelivered = F.lit(None).cast("string")
    if "http_status" in payloads.columns:
        status = F.col("http_status")
        undelivered = F.when(status.isNull(), "network").when(~status.between(200, 299), "http")
        joined = joined.withColumn("body", F.when(undelivered.isNull(), F.col("body")))
    found = harvest_links(joined, "body", "page_url", pattern=F.col("link_pattern"), **options)
    return found.withColumn(
        "error_kind",
        F.when(undelivered.isNotNull(), undelivered)
        .when(F.col("link_pattern").isNull(), "no-pattern")
        .when(~F.col("page_ok"), "config")
        .when(F.size("links") == 0, "layout"),
    )


def scrape_items(harvested: DataFrame) -> DataFrame:
    """Item rows of harvested pages that are in order."""
    keys = [c for c in PULL_COLUMNS if c in harvested.columns]
    none = F.lit(None).cast("string")
    return (
        harvested.filter(F.col("error_kind").isNull())
        .select(*keys, F.posexplode("links").alias("pos", "link"))
        .select(
            *keys,
            "pos",
            F.col("link")["url"].alias("url_raw"),
            F.col("link")["title"].alias("title"),
            none.alias("published_at_raw"),
            none.alias("summary"),
            none.alias("author"),
            no_candidates().alias("image_candidates"),
        )
    )
