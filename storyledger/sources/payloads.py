"""Landed payloads: which are usable, which are unchanged, and what is wrong with the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.text import web_trim

# The fetch types that have a parser. Data sources (json_api) have none on purpose.
SUPPORTED = ("rss", "atom", "scrape", "hn", "github_api")
# Statuses by which a host asks for fewer polls.
THROTTLE_STATUSES = (429, 503)


def classify(payloads: DataFrame) -> DataFrame:
    """Add ``payload_status``: ok, not_modified or error, and ``error_kind``.

    This looks at the status and at whether there is a body; what a parser finds is added
    later by :func:`with_parse_errors`.
    """
    status = F.col("http_status")
    kind = (
        F.when(~F.coalesce(F.col("fetch_type").isin(*SUPPORTED), F.lit(False)), "unsupported-fetch-type")
        .when(status.isNull(), "network")
        .when(status == 304, F.lit(None).cast("string"))
        .when(~status.between(200, 299), "http")
        .when(F.coalesce(web_trim(F.col("body")), F.lit("")) == "", "empty-body")
    )
    return payloads.withColumn("error_kind", kind).withColumn(
        "payload_status",
        F.when(F.col("error_kind").isNotNull(), "error")
        .when(status == 304, "not_modified")
        .otherwise("ok"),
    )


def usable(classified: DataFrame, *fetch_types: str) -> DataFrame:
    """Payloads of these types that are worth parsing. A 304 is never parsed."""
    return classified.filter(
        (F.col("payload_status") == "ok") & F.col("fetch_type").isin(*fetch_types)
    )


def error_message(kind: Column, address: Column, status: Column) -> Column:
    """A message for the error row of a payload."""
    shown = F.coalesce(status.cast("string"), F.lit("no response"))
    return (
        F.when(kind == "network", F.concat(F.lit("request to "), address, F.lit(" failed")))
        .when(kind == "http", F.concat(address, F.lit(" returned HTTP "), shown))
        .when(kind == "empty-body", F.concat(address, F.lit(" returned an empty body")))
        .when(kind == "parse", F.concat(address, F.lit(": response was not in the expected format")))
        .when(kind == "schema", F.concat(address, F.lit(": response lacked the expected list")))
        .when(kind == "no-urls", F.concat(address, F.lit(": feed had items but none carried a usable URL")))
        .when(kind == "no-pattern", F.concat(address, F.lit(": no link pattern configured, refusing to ingest")))
        .when(kind == "layout", F.concat(address, F.lit(": index matched no links")))
        .when(kind == "github", F.concat(address, F.lit(": every tracked repository failed")))
        .when(kind == "config", F.concat(F.lit("invalid index URL: "), address))
        .when(kind == "unsupported-fetch-type", F.lit("no parser for this fetch type"))
        .otherwise(kind)
    )
