"""RSS, RDF and Atom payloads to item rows."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.html import unescape
from storyledger.functions.images import feed_candidates
from storyledger.functions.steps import pinned
from storyledger.functions.text import first_text, web_trim

MEDIA = "array<struct<_url:string,_medium:string,_type:string,_width:string,_height:string>>"
TEXT = "struct<_VALUE:string,_type:string>"
RSS_ITEM = (
    f"struct<title:string, link:string, guid:struct<_VALUE:string,_isPermaLink:string>, pubDate:string,"
    f" `dc:date`:string, `dc:creator`:string, author:string, description:string, summary:string,"
    f" `content:encoded`:string, `media:content`:{MEDIA}, `media:thumbnail`:{MEDIA},"
    f" `media:group`:struct<`media:content`:{MEDIA}>, enclosure:array<struct<_url:string,_type:string>>>"
)
ATOM_ENTRY = (
    f"struct<title:{TEXT}, link:array<struct<_href:string,_rel:string>>, published:string, updated:string,"
    f" author:array<struct<name:string>>, content:{TEXT}, summary:{TEXT},"
    f" `media:content`:{MEDIA}, `media:thumbnail`:{MEDIA}>"
)
# One schema reads all three shapes, since the parser takes whatever root element there is.
FEED_SCHEMA = (
    f"channel struct<title:string, item:array<{RSS_ITEM}>>, item array<{RSS_ITEM}>,"
    f" title {TEXT}, id string, updated string, entry array<{ATOM_ENTRY}>, broken string"
)

BLOCK_TAGS = r"(?is)([^\n])</?(?:h|br|p|ul|ol|li|blockquote|section|table|tr|div)(?:.)*?>([^\n])"


def plain_summary(html: Column) -> Column:
    """A content fragment as text: block tags become line breaks, other tags vanish."""
    broken = F.regexp_replace(html, BLOCK_TAGS, "$1\n$2")
    return web_trim(unescape(F.regexp_replace(broken, r"(?s)<.*?>", "")))


def parsed_feed(body: Column) -> Column:
    """A feed payload as a struct; null for null."""
    return F.from_xml(body, FEED_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def is_feed(feed: Column) -> Column:
    """Whether a parsed payload is a feed of any shape."""
    shaped = (
        feed["channel"].isNotNull()
        | feed["item"].isNotNull()
        | feed["entry"].isNotNull()
        | (feed["id"].isNotNull() & feed["updated"].isNotNull())
    )
    return F.coalesce(feed["broken"].isNull() & shaped, F.lit(False))


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """One row per payload with the parsed document in ``feed``; ``is_feed`` tells whether it is one."""
    # Pinned: each payload is parsed once, however many filters look into the result.
    parsed = pinned(payloads, payloads.columns, {"feed": parsed_feed(F.col("body"))}).drop("body")
    return parsed.withColumn("is_feed", is_feed(F.col("feed")))


@lru_cache
def _rss_fields() -> list[Column]:
    i = F.col("item")
    link = first_text(i["link"])
    guid = first_text(i["guid"]["_VALUE"])
    content = F.coalesce(i["content:encoded"], i["description"])
    return [
        F.coalesce(link, F.when(guid.rlike("(?i)^https?://"), guid)).alias("url_raw"),
        first_text(i["title"]).alias("title"),
        first_text(i["pubDate"], i["dc:date"]).alias("published_at_raw"),
        first_text(plain_summary(i["description"]), i["summary"], i["description"]).alias("summary"),
        first_text(i["dc:creator"], i["author"]).alias("author"),
        feed_candidates(
            i["media:content"], i["media:thumbnail"], F.get(i["enclosure"], F.lit(0)), content
        ).alias("image_candidates"),
    ]


@lru_cache
def _atom_fields() -> list[Column]:
    e = F.col("item")
    alternate = F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("")) == "alternate")
    link = F.coalesce(F.get(alternate, F.lit(0)), F.get(e["link"], F.lit(0)))["_href"]
    content = e["content"]["_VALUE"]
    none = F.lit(None).cast("struct<_url:string,_type:string>")
    return [
        first_text(link).alias("url_raw"),
        first_text(e["title"]["_VALUE"]).alias("title"),
        first_text(e["published"], e["updated"]).alias("published_at_raw"),
        first_text(plain_summary(content), e["summary"]["_VALUE"], content).alias("summary"),
        first_text(F.get(e["author"], F.lit(0))["name"]).alias("author"),
        feed_candidates(e["media:content"], e["media:thumbnail"], none, content).alias("image_candidates"),
    ]


PULL_COLUMNS = ("pull_id", "source_id", "fetched_at")


def _items(parsed: DataFrame, entries: Column, fields) -> DataFrame:
    keys = [c for c in PULL_COLUMNS if c in parsed.columns]
    exploded = parsed.filter("is_feed").select(*keys, F.posexplode(entries).alias("pos", "item"))
    return exploded.select(*keys, "pos", *fields())


def rss_items(payloads: DataFrame) -> DataFrame:
    """Items of RSS 2.0 and RDF payloads. Items without a URL are kept with a null ``url_raw``."""
    feed = F.col("feed")
    entries = F.coalesce(feed["channel"]["item"], feed["item"])
    return _items(parse_feeds(payloads), entries, _rss_fields)


def atom_items(payloads: DataFrame) -> DataFrame:
    """Entries of Atom payloads."""
    return _items(parse_feeds(payloads), F.col("feed")["entry"], _atom_fields)


def feed_items(parsed: DataFrame) -> DataFrame:
    """Items of parsed feeds of any shape: what the payload is decides, not what the registry says."""
    feed = F.col("feed")
    return _items(
        parsed, F.coalesce(feed["channel"]["item"], feed["item"]), _rss_fields
    ).unionByName(_items(parsed, feed["entry"], _atom_fields))


def with_url(items: DataFrame) -> DataFrame:
    """Only items that carry a URL, as the parsers hand them on."""
    return items.filter(F.col("url_raw").isNotNull())


def feed_error(feed: Column, parsed: Column) -> Column:
    """What is wrong with a feed payload: ``parse``, ``no-urls`` or null. ``parsed`` tells whether it is a feed.

    Read from the struct of the payload, so nothing is exploded or shuffled.
    """
    rss = F.coalesce(feed["channel"]["item"], feed["item"], F.array().cast(f"array<{RSS_ITEM}>"))
    atom = F.coalesce(feed["entry"], F.array().cast(f"array<{ATOM_ENTRY}>"))
    n_items = F.size(rss) + F.size(atom)

    def has_rss_url(i: Column) -> Column:
        guid = first_text(i["guid"]["_VALUE"])
        return first_text(i["link"]).isNotNull() | F.coalesce(guid.rlike("(?i)^https?://"), F.lit(False))

    links = F.array().cast("array<struct<_href:string,_rel:string>>")
    usable = F.exists(rss, has_rss_url) | F.exists(
        atom, lambda e: F.exists(F.coalesce(e["link"], links), lambda k: first_text(k["_href"]).isNotNull())
    )
    return F.when(~parsed, "parse").when((n_items > 0) & ~usable, "no-urls")
