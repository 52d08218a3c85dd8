"""Hourly partial aggregates of documents and polls, and marts that read them instead of the tables.

Every batch adds its own rows per source and hour; rows of one source and hour from several batches simply add up (counts,
maxima, the latest error with its time), so nothing is rewritten. A window that begins inside an hour takes that hour
from the table itself, by its date and time bounds, and all later hours from the partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.plans import marts
from storyledger.sources.tables import fetched_since

HOUR = "INTERVAL 1 HOUR"


def document_hours(docs: DataFrame) -> DataFrame:
    """``source_id``, ``hour``, ``n`` documents, ``images`` and ``wired`` among them."""
    return docs.groupBy("source_id", F.date_trunc("hour", "fetched_at").alias("hour")).agg(
        F.count("*").alias("n"), F.count("image_url").alias("images"), F.count("origin_wire_byline").alias("wired")
    )


def log_hours(log: DataFrame) -> DataFrame:
    """``source_id``, ``hour``, ``attempts``, ``failures``, ``peak_new``, and the last ``failure`` (``at``, ``error``)."""
    failed = F.col("error").isNotNull()
    return log.groupBy("source_id", F.date_trunc("hour", "attempted_at").alias("hour")).agg(
        F.count("*").alias("attempts"), F.count_if(failed).alias("failures"), F.max("items_new").alias("peak_new"),
        F.max(F.when(failed, F.struct(F.col("attempted_at").alias("at"), "error"))).alias("failure"),
    )


def _edge(asof: Column, period: str) -> tuple[Column, Column]:
    """When a window begins, and the hour that it begins in."""
    since = asof - F.expr(f"INTERVAL {period}")
    return since, F.date_trunc("hour", since)


def _first_hour(rows: DataFrame, at: str, asof: Column, period: str) -> DataFrame:
    """Rows of the hour that a window begins in, from its beginning on."""
    since, edge = _edge(asof, period)
    bounded = fetched_since(rows, asof, period) if at == "fetched_at" else rows.filter(F.col(at) > since)
    bounded = bounded.filter(F.col(at) < edge + F.expr(HOUR))
    if "fetch_date" in rows.columns:
        bounded = bounded.filter(F.col("fetch_date") <= F.to_date(edge + F.expr(HOUR)))
    return bounded


def _within(asof: Column, period: str) -> Column:
    return F.col("hour") > _edge(asof, period)[1]


def _counts(hours: DataFrame, docs: DataFrame, asof: Column, *by: str) -> DataFrame:
    """Documents in all, in a day and in a week, from whole hours and the two first ones."""
    def when(condition: Column, column: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    day, week = _within(asof, marts.DAY), _within(asof, marts.WEEK)
    always = F.lit(True)
    no, parts = F.lit(False), []
    sources = [
        (hours, always, day, week),
        (document_hours(_first_hour(docs, "fetched_at", asof, marts.DAY)), no, always, no),
        (document_hours(_first_hour(docs, "fetched_at", asof, marts.WEEK)), no, no, always),
    ]
    for rows, total, of_day, of_week in sources:
        parts.append(rows.groupBy(*by).agg(
            when(total, "n").alias("docs_total"), when(of_day, "n").alias("docs_24h"), when(of_day, "images").alias("with_image_24h"),
            when(of_day, "wired").alias("wire_flagged_24h"), when(of_week, "n").alias("docs_7d"), when(of_week, "images").alias("with_image_7d"),
        ))
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def source_health(
    registry: DataFrame, hours: DataFrame, polls: DataFrame, docs: DataFrame, log: DataFrame, errors: DataFrame, asof: Column
) -> DataFrame:
    """``marts.source_health`` from ``document_hours`` and ``log_hours``; the tables give two hours and one at most."""
    per_docs = _counts(hours, docs, asof, "source_id").select(
        "source_id", "docs_24h", "docs_total", marts.percent(F.col("with_image_7d"), F.col("docs_7d")).alias("image_pct_7d")
    )
    first = log_hours(_first_hour(log, "attempted_at", asof, marts.WEEK)).withColumn("hour", F.lit(None).cast("timestamp"))
    peak = F.when(F.coalesce(_within(asof, marts.WEEK), F.lit(True)), F.col("peak_new"))
    per_log = polls.select(*first.columns).unionByName(first).groupBy("source_id").agg(
        F.max(peak).alias("peak_new"), F.max("failure")["error"].alias("last_error")
    )
    return marts.health_rows(registry, per_docs, per_log, errors)


def totals(registry: DataFrame, hours: DataFrame, docs: DataFrame, errors: DataFrame, asof: Column) -> DataFrame:
    """``marts.totals`` from ``document_hours``."""
    counts = _counts(hours, docs, asof).select("docs_total", "docs_24h", "wire_flagged_24h", "with_image_24h")
    return marts.totals_of(registry, counts, errors)
