"""JSON payloads to item rows: story search and code releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.images import no_candidates
from storyledger.functions.steps import pinned
from storyledger.limits import left_chars
from storyledger.functions.text import blank_to_null, web_trim
from storyledger.sources.feeds import PULL_COLUMNS

# The permalink of a story, and the longest release summary.
STORY_PERMALINK = "https://news.ycombinator.com/item?id="

STORY = "struct<objectID:string,title:string,url:string,author:string,created_at:string,story_text:string>"
STORY_SCHEMA = f"hits array<{STORY}>"
RELEASE = (
    "struct<html_url:string,name:string,tag_name:string,published_at:string,body:string,"
    "draft:boolean,prerelease:boolean,author:struct<login:string>>"
)
RELEASE_SCHEMA = f"array<{RELEASE}>"


def _json_kind(body: Column) -> Column:
    """'object', 'array', another word, or null when the text is not JSON."""
    variant_type = F.schema_of_variant(F.try_parse_json(body))
    return F.when(variant_type.startswith("OBJECT"), "object").when(
        variant_type.startswith("ARRAY"), "array"
    ).when(variant_type.isNotNull(), "other")


def _has_list(body: Column, field: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def parsed_stories(body: Column) -> Column:
    """A story-search reply as a struct."""
    return F.from_json(body, STORY_SCHEMA)


def story_error(body: Column) -> Column:
    """A reply that is not JSON (``parse``) or has no list of hits (``schema``); null for null."""
    kind = F.when(F.try_parse_json(body).isNull(), "parse").when(~_has_list(body, "hits"), "schema")
    return F.when(body.isNotNull(), kind)


def parsed_releases(body: Column) -> Column:
    """A list of releases; null if the reply is none."""
    return F.when(_json_kind(body) == "array", F.from_json(body, RELEASE_SCHEMA))


def story_items(payloads: DataFrame) -> DataFrame:
    """Story-search hits of payloads."""
    keys = [c for c in PULL_COLUMNS if c in payloads.columns]
    return story_items_of(pinned(payloads, keys, {"reply": parsed_stories(F.col("body"))}))


def story_items_of(parsed: DataFrame) -> DataFrame:
    """Story-search hits of parsed replies. The item is the discussion page; the story it links to is its target."""
    keys = [c for c in PULL_COLUMNS if c in parsed.columns]
    hits = parsed.select(*keys, F.posexplode(F.col("reply")["hits"]).alias("pos", "hit"))
    hit = F.col("hit")
    return hits.filter(F.coalesce(hit["objectID"], F.lit("")) != "").select(
        *keys,
        "pos",
        F.concat(F.lit(STORY_PERMALINK), hit["objectID"]).alias("url_raw"),
        web_trim(hit["title"]).alias("title"),
        hit["created_at"].alias("published_at_raw"),
        web_trim(hit["story_text"]).alias("summary"),
        hit["author"].alias("author"),
        no_candidates().alias("image_candidates"),
        hit["url"].alias("discovery_target_url"),
    )


def release_items(payloads: DataFrame, summary_chars: int | None = None) -> DataFrame:
    """Releases of payloads of tracked repositories."""
    keys = [c for c in PULL_COLUMNS if c in payloads.columns]
    parsed = pinned(payloads, [*keys, "part", "part_no"], {"releases": parsed_releases(F.col("body"))})
    return release_items_of(parsed, summary_chars)


def release_items_of(parsed: DataFrame, summary_chars: int | None = None) -> DataFrame:
    """Releases of tracked repositories; ``part`` names the repository a payload is for and
    ``part_no`` its place in the pull.

    Drafts and releases without a page are dropped; pre-releases stay.
    """
    keys = [c for c in PULL_COLUMNS if c in parsed.columns]
    rows = parsed.select(*keys, "part", "part_no", F.posexplode("releases").alias("at", "release"))
    r = F.col("release")
    name = F.coalesce(
        blank_to_null(web_trim(r["name"])), blank_to_null(r["tag_name"]), F.lit("release")
    )
    return rows.filter(
        ~F.coalesce(r["draft"], F.lit(False)) & (F.coalesce(r["html_url"], F.lit("")) != "")
    ).select(
        *keys,
        # Repositories of a pull follow each other in the order they were asked for.
        (F.shiftleft(F.col("part_no").cast("long"), 32) + F.col("at")).alias("pos"),
        r["html_url"].alias("url_raw"),
        F.concat(F.col("part"), F.lit(" "), name).alias("title"),
        r["published_at"].alias("published_at_raw"),
        left_chars(web_trim(r["body"]), summary_chars).alias("summary"),
        r["author"]["login"].alias("author"),
        no_candidates().alias("image_candidates"),
    )


def release_errors(parsed: DataFrame) -> DataFrame:
    """Pulls in which every repository failed and no release came out; partial failure is fine.

    ``parsed`` has the ``releases`` of usable payloads and null for the others.
    """
    shown = F.filter(
        "releases", lambda r: ~F.coalesce(r["draft"], F.lit(False)) & (F.coalesce(r["html_url"], F.lit("")) != "")
    )
    keys = [c for c in PULL_COLUMNS if c in parsed.columns]
    return (
        parsed.groupBy(*keys)
        .agg(F.count_if(F.col("releases").isNull()).alias("failed"), F.sum(F.when(F.col("releases").isNotNull(), F.size(shown)).otherwise(0)).alias("n_items"))
        .filter((F.col("failed") > 0) & (F.col("n_items") == 0))
        .select(*keys, F.lit(None).cast("int").alias("http_status"), F.lit("github").alias("error_kind"))
    )
