"""Table schemas, value domains and keys."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the enumerated columns, in declaration order.
VERTICALS = ("finance", "tech")
SOURCE_KINDS = ("news", "data")
SOURCE_TYPES = (
    "regulator", "exchange", "industry_body", "outlet", "wire", "analyst_blog",
    "company_blog", "code_release", "community",
)
SOURCE_ROLES = ("record", "discovery")
FETCH_TYPES = ("rss", "atom", "scrape", "hn", "github_api", "json_api")
AUDIT_STRATEGIES = ("index_diff", "calendar_expect", "proxy_sample", "none")
CONFIDENCES = ("high", "low", "suspect")
EXTRACTION_STATUSES = ("pending", "ok", "partial", "failed", "skipped")
WIRE_EVIDENCE = ("byline", "dateline", "mention")
COVERAGE_STATUSES = ("ok", "gap", "error")
IMAGE_SOURCES = (
    "media_content", "media_thumbnail", "enclosure", "content_img", "og", "twitter", "inline",
)
PRIMARY_DOMAIN_TYPES = ("regulator", "exchange")

S, I, B, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
TEXTS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SOURCES = _struct(
    ("source_id", S), ("slug", S), ("name", S), ("vertical", S), ("source_kind", S),
    ("source_type", S), ("source_role", S), ("feed_url", S), ("fetch_type", S),
    ("user_agent", S), ("index_url", S), ("index_link_pattern", S), ("lowercase_url_path", B),
    ("audit_strategy", S), ("active_hours_tz", S), ("active_start_hour", I),
    ("active_end_hour", I), ("active_interval_min", I), ("off_interval_min", I),
    ("next_fetch_at", TS), ("last_fetched_at", TS), ("last_etag", S), ("last_modified", S),
    ("feed_window_size", I), ("reliability_weight", T.FloatType()), ("is_full_text", B),
    ("is_active", B), ("topics", TEXTS), ("notes", S), ("created_at", TS), ("updated_at", TS),
)

RAW_DOCUMENTS = _struct(
    ("document_id", S), ("pull_id", S), ("source_id", S), ("vertical", S), ("url", S), ("url_raw", S), ("title", S),
    ("text_content", S), ("html_snapshot", S), ("fetched_at", TS), ("published_at", TS),
    ("published_at_confidence", S), ("published_at_reason", S), ("extraction_status", S),
    ("extraction_error", S), ("origin_primary_links", TEXTS), ("origin_wire_byline", S),
    ("origin_wire_evidence", S), ("origin_has_verbatim_quote", B),
    ("origin_discovery_target_url", S), ("image_url", S), ("image_source", S),
    ("image_width", I), ("image_height", I), ("is_processed", B), ("fetch_date", T.DateType()),
)

FETCH_LOG = _struct(
    ("source_id", S), ("attempted_at", TS), ("http_status", I), ("items_seen", I),
    ("items_new", I), ("items_with_image", I), ("duration_ms", I), ("error", S),
)

COVERAGE_AUDIT = _struct(
    ("source_id", S), ("vertical", S), ("audit_date", T.DateType()), ("strategy", S),
    ("expected_count", T.LongType()), ("ingested_count", T.LongType()), ("missing_urls", TEXTS),
    ("status", S), ("detail", S),
)

SOURCE_ERRORS = _struct(
    ("source_id", S), ("error_type", S), ("message", S), ("occurred_at", TS), ("resolved_at", TS),
)

PAYLOADS = _struct(
    ("pull_id", S), ("source_id", S), ("part", S), ("part_no", I), ("fetch_type", S), ("http_status", I),
    ("body", S), ("etag", S), ("last_modified", S), ("fetched_at", TS),
)

TABLES = {
    "sources": SOURCES,
    "raw_documents": RAW_DOCUMENTS,
    "fetch_log": FETCH_LOG,
    "coverage_audit": COVERAGE_AUDIT,
    "source_errors": SOURCE_ERRORS,
}
# Columns each table is unique by, and the enumerated columns of each table.
KEYS = {
    "sources": ["slug"],
    "raw_documents": ["url"],
    "coverage_audit": ["source_id", "audit_date"],
}
DOMAINS = {
    "sources": {
        "vertical": VERTICALS,
        "source_kind": SOURCE_KINDS,
        "source_type": SOURCE_TYPES,
        "source_role": SOURCE_ROLES,
        "fetch_type": FETCH_TYPES,
        "audit_strategy": AUDIT_STRATEGIES,
    },
    "raw_documents": {
        "vertical": VERTICALS,
        "published_at_confidence": CONFIDENCES,
        "extraction_status": EXTRACTION_STATUSES,
        "origin_wire_evidence": WIRE_EVIDENCE,
        "image_source": IMAGE_SOURCES,
    },
    "coverage_audit": {"vertical": VERTICALS, "strategy": AUDIT_STRATEGIES, "status": COVERAGE_STATUSES},
}
