"""Lead images: address checks, junk shapes, dimensions and the choice among candidates."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyledger.functions.html import attr, tags
from storyledger.functions.steps import let, map_steps
from storyledger.functions.text import WHITE_SPACE, WORD_END, WORD_START, web_trim
from storyledger.functions.urls import base_parts, resolve_stages

# Sizes in pixels, and address shapes that are never a lead image.
MIN_SIDE = 3
MIN_LEAD_WIDTH = 200
MIN_INLINE_WIDTH = 400
JUNK_SHAPES = (
    r"/(?:pixel|spacer|blank|beacon|dot)\.(?:gif|png)(?:$|\?)",
    rf"{WORD_START}1x1{WORD_END}",
    r"/track(?:ing)?\?",
    rf"{WORD_START}placeholder{WORD_END}",
    rf"{WORD_START}default[-_]?(?:image|thumb|avatar){WORD_END}",
    rf"{WORD_START}sprite{WORD_END}",
    r"/logo[-_.]",
)
JUNK = "(?i)" + "|".join(f"(?:{shape})" for shape in JUNK_SHAPES)
IMAGE_EXTENSION = r"(?i)\.(?:jpe?g|png|webp|gif|avif)(?:$|\?|#)"
IMAGE_FOLDER = r"(?i)/(?:image|photo|media|img)s?/"
# Page metadata that carries a lead image, in order of preference.
PAGE_METADATA = (
    ("meta", "property", "og:image", "og"),
    ("meta", "property", "og:image:url", "og"),
    ("meta", "name", "twitter:image", "twitter"),
    ("meta", "name", "twitter:image:src", "twitter"),
    ("link", "rel", "image_src", "inline"),
)

CANDIDATES = "array<struct<url:string,source:string,width:string,height:string>>"


def no_candidates() -> Column:
    return F.array().cast(CANDIDATES)


def parse_dimension(value: Column) -> Column:
    """The leading number of '640', '640px' or '640.5', rounded; null unless above zero."""
    number = F.regexp_extract(value, rf"^[{WHITE_SPACE}]*([0-9]+(?:\.[0-9]+)?)", 1)
    parsed = F.when(F.char_length(number) <= 12, number.try_cast("double"))
    return F.when(parsed > 0, F.floor(parsed + 0.5).try_cast("int"))


def is_junk_image(url: Column) -> Column:
    return url.rlike(JUNK)


def clean_reference(raw: Column) -> Column:
    """The trimmed address, or null when it is blank, inlined or holds white space."""
    text = web_trim(raw)
    return F.when(
        (text != "") & ~text.rlike(r"(?i)^data:") & ~text.rlike(f"[{WHITE_SPACE}]"), text
    )


@lru_cache
def select_lead_image(candidates: str, base_url: str) -> Column:
    """The lead image among the column ``candidates``: a struct of url, source, width, height, or null.

    Candidates come in order of preference. The source of the first usable one decides the
    tier, and the widest of that tier wins, the earlier one on a tie.
    """
    base = base_parts(F.col(base_url))
    start = F.transform(
        F.filter(F.col(candidates), lambda c: clean_reference(c["url"]).isNotNull()),
        lambda c: F.struct(
            clean_reference(c["url"]).alias("href"),
            base.alias("base"),
            c["source"].alias("source"),
            parse_dimension(c["width"]).alias("width"),
            parse_dimension(c["height"]).alias("height"),
        ),
    )
    fields = ["href", "base", "source", "width", "height"]
    resolved = F.transform(
        map_steps(start, fields, resolve_stages("href", "base", keep_fragment=False)),
        lambda c: F.struct(
            c["resolved"].alias("url"), c["source"].alias("source"), c["width"], c["height"]
        ),
    )
    usable = F.filter(
        resolved,
        lambda c: c["url"].isNotNull()
        & ~is_junk_image(c["url"])
        & (F.coalesce(c["width"], F.lit(MIN_LEAD_WIDTH)) >= MIN_LEAD_WIDTH)
        & (F.coalesce(c["height"], F.lit(MIN_SIDE)) >= MIN_SIDE),
    )
    # Fold once: keep the first usable candidate, replace it by a wider one of the same source.
    empty = F.lit(None).cast("struct<url:string,source:string,width:int,height:int>")
    return F.aggregate(
        usable,
        empty,
        lambda best, c: F.when(
            best.isNull()
            | (
                (c["source"] == best["source"])
                & (F.coalesce(c["width"], F.lit(0)) > F.coalesce(best["width"], F.lit(0)))
            ),
            F.struct(c["url"], c["source"], c["width"], c["height"]),
        ).otherwise(best),
    )


def first_image_in_html(html: Column) -> Column:
    """Address of the first plausible ``<img>`` of a fragment; the lazy-load address goes first."""
    quoted = r"""\s*=\s*["']([^"']+)["']"""
    sources = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1)),
        lambda tag: F.when(
            tag.rlike(rf"(?i)\bdata-src{quoted}"), F.regexp_extract(tag, rf"(?i)\bdata-src{quoted}", 1)
        ).otherwise(F.regexp_extract(tag, rf"(?i)\bsrc{quoted}", 1)),
    )
    plausible = F.filter(
        sources,
        lambda s: (s != "")
        & ~s.rlike(r"(?i)^data:")
        & ~is_junk_image(s)
        & (s.rlike(IMAGE_EXTENSION) | s.rlike(IMAGE_FOLDER)),
    )
    return F.get(plausible, F.lit(0))


def _candidate(url: Column, source: Column | str, width: Column | None = None, height: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        url.alias("url"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        (none if width is None else width).alias("width"),
        (none if height is None else height).alias("height"),
    )


def media_candidates(elements: Column, source: str) -> Column:
    """Candidates of ``media:*`` elements; only an explicit non-image kind is dropped."""
    kept = F.filter(
        F.coalesce(elements, F.array().cast("array<struct<_url:string,_medium:string,_type:string,_width:string,_height:string>>")),
        lambda m: (F.coalesce(m["_url"], F.lit("")) != "")
        & (F.coalesce(F.nullif(m["_medium"], F.lit("")), F.lit("image")) == "image")
        & F.coalesce(F.nullif(m["_type"], F.lit("")), F.lit("image/")).startswith("image/"),
    )
    return F.transform(kept, lambda m: _candidate(m["_url"], source, m["_width"], m["_height"]))


def feed_candidates(media: Column, thumbnails: Column, enclosure: Column, content: Column) -> Column:
    """media:content, then media:thumbnail, then the enclosure, then an ``<img>`` of the content."""
    usable = (F.coalesce(enclosure["_url"], F.lit("")) != "") & F.coalesce(
        enclosure["_type"], F.lit("image/")
    ).startswith("image/")
    inline = first_image_in_html(content)
    return F.concat(
        media_candidates(media, "media_content"),
        media_candidates(thumbnails, "media_thumbnail"),
        F.when(usable, F.array(_candidate(enclosure["_url"], "enclosure"))).otherwise(no_candidates()),
        F.when(inline.isNotNull(), F.array(_candidate(inline, "content_img"))).otherwise(no_candidates()),
    )


def page_candidates(html: Column, most: int | None = None) -> Column:
    """Candidates of a landed page: metadata first, then wide ``<img>`` elements.

    With ``most``, inline images stop when the whole list has so many entries; metadata is never cut.
    """
    found = F.concat(
        let(tags(html, "meta"), lambda t: _metadata(t, "meta")),
        let(tags(html, "link"), lambda t: _metadata(t, "link")),
    )
    return let(found, lambda metadata: _with_inline(metadata, html, most))


def _metadata(found: Column, tag: str) -> Column:
    groups = []
    for name, key, value, source in PAGE_METADATA:
        if name != tag:
            continue
        urls = F.transform(
            F.filter(found, lambda t: attr(t, key) == value),
            lambda t: F.coalesce(attr(t, "content"), attr(t, "href")),
        )
        groups.append(
            F.transform(
                F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != ""), lambda u: _candidate(u, source)
            )
        )
    return F.concat(*groups)


def _with_inline(metadata: Column, html: Column, most: int | None) -> Column:
    inline = F.filter(
        F.transform(
            tags(html, "img"),
            lambda t: _candidate(
                F.coalesce(attr(t, "data-src"), attr(t, "src")),
                "inline",
                parse_dimension(attr(t, "width")).cast("string"),
                parse_dimension(attr(t, "height")).cast("string"),
            ),
        ),
        lambda c: (F.coalesce(c["url"], F.lit("")) != "")
        & (F.coalesce(c["width"].cast("int"), F.lit(0)) >= MIN_INLINE_WIDTH),
    )
    if most is None:
        return F.concat(metadata, inline)
    # The check runs after each addition, so one inline image always gets in.
    room = F.greatest(F.lit(most) - F.size(metadata), F.lit(1))
    return F.concat(metadata, F.slice(inline, F.lit(1), room))
