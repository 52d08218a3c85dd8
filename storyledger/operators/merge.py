"""Merges into the stored tables.

Each function returns rows (to append, or the new table) and leaves writing to the caller.
Writers for the two cases that rewrite stored partitions are at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.operators.identity import first_per_key, not_held
from storyledger.operators.ordered import next_event
from storyledger.sizing import broadcast_if_small
from storyledger.sources.tables import read_table, write_table

# Registry columns that belong to the running system, not to its configuration.
RUNTIME_COLUMNS = (
    "next_fetch_at", "last_etag", "last_modified", "last_fetched_at", "feed_window_size",
)
TEXT_RETENTION = "7 days"
HTML_RETENTION = "48 hours"
URL_PATH = r"^https?://[^/?#]+([^?#]*)"


def insert_if_absent(
    new: DataFrame, held: DataFrame, *order: str, small_batch: bool = False
) -> DataFrame:
    """The rows of ``new`` to append: one per URL, and none whose URL is held.

    Among new rows of one URL the smallest by ``order`` is kept.
    """
    unique = first_per_key(new, ["url"], F.struct(*order))
    return not_held(unique, held, small_batch=small_batch)


def upsert_registry(current: DataFrame, config: DataFrame, asof: Column) -> DataFrame:
    """Insert or update configuration by slug. Runtime state of known sources is left alone.

    A configured null overwrites; a source that the configuration lacks stays.
    """
    names = [c for c in current.columns if c != "slug"]
    old = current.select("slug", *[F.col(c).alias(f"old_{c}") for c in names], F.lit(True).alias("had"))
    new = config.select("slug", *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("got"))
    both = old.join(new, "slug", "full_outer")
    had, got = F.col("had").isNotNull(), F.col("got").isNotNull()

    def pick(name: str) -> Column:
        kept, given = F.col(f"old_{name}"), F.col(f"new_{name}")
        if name in RUNTIME_COLUMNS or name in ("source_id", "created_at"):
            return F.when(had, kept).otherwise(given)
        if name == "updated_at":
            return F.when(got, asof).otherwise(kept)
        return F.when(got, given).otherwise(kept)

    return both.select(
        *[F.col(c) if c == "slug" else pick(c).alias(c) for c in current.columns]
    )


def upsert_audit(current: DataFrame, runs: DataFrame, run_order: str = "run_no") -> DataFrame:
    """One row per source and date: a later run overwrites. ``current`` counts as the first run."""
    rows = current.withColumn(run_order, F.lit(-1)).unionByName(runs)
    latest = first_per_key(rows, ["source_id", "audit_date"], -F.col(run_order))
    return latest.drop(run_order)


def fetch_log_rows(outcomes: DataFrame) -> DataFrame:
    """One log row per attempt, whether it succeeded or not."""
    return outcomes.select(
        "source_id",
        "attempted_at",
        F.col("http_status").cast("int").alias("http_status"),
        *[
            F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
            for c in ("items_seen", "items_new", "items_with_image", "duration_ms")
        ],
        "error",
    )


def source_error_rows(failures: DataFrame) -> DataFrame:
    """One open error row per failed attempt: ``error_kind`` and ``message`` at ``attempted_at``."""
    return failures.filter(F.col("error_kind").isNotNull()).select(
        "source_id",
        F.col("error_kind").alias("error_type"),
        "message",
        F.col("attempted_at").alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def resolve_open_errors(errors: DataFrame, log: DataFrame) -> DataFrame:
    """Close each open error at its source's first success after it; a 304 is a success."""
    success = F.col("error").isNull() & F.col("http_status").isNotNull()
    columns = errors.columns
    payload = [c for c in columns if c != "source_id"]
    events = errors.select(
        "source_id", F.col("occurred_at").alias("__at"), F.struct(*payload).alias("__row")
    ).unionByName(
        log.filter(success).select("source_id", F.col("attempted_at").alias("__at")),
        allowMissingColumns=True,
    )
    found = next_event(events, "source_id", "__at", F.col("__row").isNull(), "__closed")
    row = F.col("__row")
    return found.filter(row.isNotNull()).select(
        *[
            F.coalesce(row["resolved_at"], F.col("__closed")).alias(c)
            if c == "resolved_at"
            else (F.col(c) if c == "source_id" else row[c].alias(c))
            for c in columns
        ]
    )


def _expired(asof: Column, period: str) -> Column:
    return F.col("fetched_at") < asof - F.expr(f"INTERVAL {period}")


def apply_retention(
    docs: DataFrame, asof: Column, text_period: str = TEXT_RETENTION, html_period: str = HTML_RETENTION
) -> DataFrame:
    """Null the text and the page snapshot once they are past their period. Rows always stay."""
    cleared = {
        "text_content": _expired(asof, text_period),
        "html_snapshot": _expired(asof, html_period),
    }
    return docs.select(
        *[F.when(~cleared[c], F.col(c)).alias(c) if c in cleared else F.col(c) for c in docs.columns]
    )


def retention_counts(
    docs: DataFrame, asof: Column, text_period: str = TEXT_RETENTION, html_period: str = HTML_RETENTION
) -> DataFrame:
    """How many texts and snapshots a pass clears."""
    return docs.agg(
        F.count_if(_expired(asof, text_period) & F.col("text_content").isNotNull()).alias("text_cleared"),
        F.count_if(_expired(asof, html_period) & F.col("html_snapshot").isNotNull()).alias("html_cleared"),
    )


def retention_debt(
    docs: DataFrame, asof: Column, text_period: str = TEXT_RETENTION, html_period: str = HTML_RETENTION
) -> DataFrame:
    """Rows that still hold a heavy column past its period; zero after a pass."""
    overdue = (_expired(asof, text_period) & F.col("text_content").isNotNull()) | (
        _expired(asof, html_period) & F.col("html_snapshot").isNotNull()
    )
    return docs.agg(F.count_if(overdue).alias("rows_in_debt"))


def stale_urls(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents of path-lowering sources whose stored path is not lower case. Queries may be."""
    flagged = registry.filter("lowercase_url_path").select("source_id")
    path = F.regexp_extract("url", URL_PATH, 1)
    return docs.filter(F.col("url").rlike(URL_PATH) & (path != F.lower(path))).join(
        broadcast_if_small(flagged), "source_id", "left_semi"
    )


def purge_stale_urls(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents without those of :func:`stale_urls`. The registry side alone is joined."""
    flagged = registry.filter("lowercase_url_path").select("source_id", F.lit(True).alias("__flag"))
    path = F.regexp_extract("url", URL_PATH, 1)
    stale = (
        F.coalesce(F.col("__flag"), F.lit(False))
        & F.col("url").rlike(URL_PATH)
        & (path != F.lower(path))
    )
    return (
        docs.join(broadcast_if_small(flagged), "source_id", "left")
        .filter(~stale)
        .select(*docs.columns)
    )


# ---- stored tables -------------------------------------------------------------------


def retain_stored(spark: SparkSession, root: str, asof: Column) -> None:
    """Apply retention in place, rewriting only date partitions that still hold heavy columns."""
    # Read as stored: columns that the declared schema does not know are kept.
    docs = spark.read.option("mergeSchema", "true").parquet(f"{root}/raw_documents")
    old = docs.filter(
        (F.col("fetch_date") <= F.to_date(asof - F.expr(f"INTERVAL {HTML_RETENTION}")))
    )
    owing = (
        old.filter(
            (F.col("text_content").isNotNull() & _expired(asof, TEXT_RETENTION))
            | (F.col("html_snapshot").isNotNull() & _expired(asof, HTML_RETENTION))
        )
        .select("fetch_date")
        .distinct()
    )
    touched = old.join(broadcast_if_small(owing), "fetch_date", "left_semi")
    write_table(apply_retention(touched, asof), root, "raw_documents", mode="overwrite")


def store_audit(spark: SparkSession, root: str, runs: DataFrame) -> None:
    """Merge audit runs into the stored table, rewriting only the dates that they cover."""
    current = read_table(spark, root, "coverage_audit")
    dates = runs.select("audit_date").distinct()
    touched = current.join(broadcast_if_small(dates), "audit_date", "left_semi")
    write_table(upsert_audit(touched, runs), root, "coverage_audit", mode="overwrite")
