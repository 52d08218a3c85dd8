"""What a batch of payloads changes: documents, log, errors and the schedule, from one outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.functions.urls import with_budget_host
from storyledger.limits import NO_LIMITS, Limits
from storyledger.operators.identity import first_per_key
from storyledger.operators.merge import fetch_log_rows, resolve_open_errors, source_error_rows
from storyledger.operators.schedule import advance_over_attempts, carried_throttles
from storyledger.plans.ingest import error_rows, errors_of, fetch_outcomes, ingest, parse_payloads
from storyledger.plans.rollups import document_hours, log_hours
from storyledger.session import landed
from storyledger.sizing import broadcast_if_small
from storyledger.sources.store import Store

THROTTLES = "host string, throttles bigint"
ERRORS = "source_id string, error_type string, message string, occurred_at timestamp, resolved_at timestamp"


@dataclass(frozen=True)
class Settled:
    """The rows that a batch adds, and the tables that it leaves behind."""

    documents: DataFrame
    log: DataFrame
    closed_errors: DataFrame
    open_errors: DataFrame
    registry: DataFrame
    throttles: DataFrame


def settle(
    payloads: DataFrame, pages: DataFrame, registry: DataFrame, held: Callable[[DataFrame], DataFrame],
    open_errors: DataFrame, throttles: DataFrame, limits: Limits = NO_LIMITS,
) -> Settled:
    """One batch, from payloads to every table that it changes.

    ``held`` gives the stored URLs that items may meet. Among documents of one URL the first of the earliest pull stays.
    Every failed pull opens an error; every successful one, an unchanged payload included, closes the errors of
    its source before it. ``throttles`` has the throttled polls of each host since its last success, up to this batch.
    """
    parsed = parse_payloads(payloads, registry, limits)
    items, documents = ingest(parsed, pages, registry, held, small_batch=True, limits=limits)
    inserted = landed(first_per_key(documents, ["url"], F.struct("fetched_at", "pull_id", "url_raw")), "inserted")
    failures = landed(errors_of(parsed), "failures")
    outcomes = landed(fetch_outcomes(payloads, items, documents, inserted, failures), "outcomes")
    log = fetch_log_rows(outcomes)
    opened = source_error_rows(error_rows(failures, registry))
    errors = landed(resolve_open_errors(open_errors.unionByName(opened), log), "errors")
    hosts = with_budget_host(registry.select("source_id", "feed_url"), "feed_url", out="host").select("source_id", "host")
    polled = outcomes.join(broadcast_if_small(hosts), "source_id")
    after = landed(carried_throttles(throttles, polled, "host", "pull_id"), "throttles")
    return Settled(
        documents=inserted.withColumn("fetch_date", F.to_date("fetched_at")),
        log=log,
        closed_errors=errors.where("resolved_at IS NOT NULL"),
        open_errors=errors.where("resolved_at IS NULL"),
        registry=advance_over_attempts(registry, polled.join(after, "host"), "pull_id"),
        throttles=after,
    )


def found(spark: SparkSession, store: Store, registry: DataFrame, held: DataFrame) -> None:
    """The first version of a store: a registry, and URLs that are held already."""
    none = {"open_errors": spark.createDataFrame([], ERRORS), "throttles": spark.createDataFrame([], THROTTLES)}
    store.commit(spark, 0, held.select("url"), {}, {"sources": registry, **none})


def settle_into(
    spark: SparkSession, store: Store, version: int, payloads: DataFrame, pages: DataFrame, limits: Limits = NO_LIMITS
) -> bool:
    """Settle a batch as ``version`` of the store; False if that version is complete already, and nothing is done."""
    if store.runs(spark, version) is not None:
        return False
    before = version - 1
    tables = [store.read_whole(spark, name, before) for name in ("sources", "open_errors", "throttles")]
    done = settle(payloads, pages, tables[0], lambda urls: store.held(spark, urls, before), *tables[1:], limits)
    appended = {
        "raw_documents": done.documents, "fetch_log": done.log, "source_errors": done.closed_errors,
        "document_hours": document_hours(done.documents), "log_hours": log_hours(done.log),
    }
    replaced = {"sources": done.registry, "open_errors": done.open_errors, "throttles": done.throttles}
    store.commit(spark, version, done.documents.select("url"), appended, replaced)
    return True
