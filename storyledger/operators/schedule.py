"""Polling: due sources, throttle backoff and the next poll time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.times import known_zone, next_fetch_at
from storyledger.operators.ordered import hits_since_reset
from storyledger.sizing import broadcast_if_small
from storyledger.sources.payloads import THROTTLE_STATUSES

# Shortest gap between polls of a host, and the longest backoff.
MIN_GAP_MS = 1_000
MAX_BACKOFF_MS = 300_000


def due_sources(registry: DataFrame, asof: Column, limit: int) -> DataFrame:
    """The ``limit`` active news sources that have been due longest."""
    return (
        registry.filter(
            F.col("is_active") & (F.col("source_kind") == "news") & (F.col("next_fetch_at") <= asof)
        )
        .orderBy("next_fetch_at", "slug")
        .limit(limit)
    )


def backoff_ms(throttles: Column) -> Column:
    """Doubles with each throttle since the last success, up to the limit; zero without one."""
    doubled = F.lit(float(MIN_GAP_MS)) * F.pow(F.lit(2.0), F.least(throttles, F.lit(20)))
    return F.when(throttles > 0, F.least(doubled, F.lit(float(MAX_BACKOFF_MS)))).otherwise(0).cast("long")


def _succeeded(log: DataFrame) -> Column:
    return F.col("error").isNull() & F.col("http_status").isNotNull()


def _throttled() -> Column:
    return F.coalesce(F.col("http_status").isin(*THROTTLE_STATUSES), F.lit(False))


def throttle_state(log: DataFrame, key: str = "host") -> DataFrame:
    """Per host: throttles since its last success, and the backoff that they ask for.

    Two partial aggregations; the second reads throttled attempts only. Other errors neither
    count nor reset.
    """
    last = log.groupBy(key).agg(
        F.max(F.when(_succeeded(log), F.col("attempted_at"))).alias("last_success"),
    )
    since = (
        log.filter(_throttled())
        .select(key, "attempted_at")
        .join(broadcast_if_small(last), key)
        .filter(F.col("last_success").isNull() | (F.col("attempted_at") > F.col("last_success")))
        .groupBy(key)
        .agg(F.count("*").alias("throttles"))
    )
    return last.join(since, key, "left").select(
        key,
        F.coalesce("throttles", F.lit(0)).cast("long").alias("throttles"),
        backoff_ms(F.coalesce("throttles", F.lit(0))).alias("backoff_ms"),
    )


def throttle_history(log: DataFrame, key: str, tie: str) -> DataFrame:
    """Each attempt with the host's throttles since its last success and the backoff after it."""
    counted = hits_since_reset(
        log, key, "attempted_at", tie, hit=_throttled(), reset=_succeeded(log), out="throttles"
    )
    return counted.withColumn("backoff_ms", F.when(_throttled(), backoff_ms(F.col("throttles"))).otherwise(0).cast("long"))


def latest_attempts(log: DataFrame, tie: str) -> DataFrame:
    """The last attempt of each source, as a partial aggregate."""
    rest = [c for c in log.columns if c != "source_id"]
    picked = log.groupBy("source_id").agg(
        F.max_by(F.struct(*rest), F.struct("attempted_at", tie)).alias("__row")
    )
    return picked.select("source_id", *[F.col("__row")[c].alias(c) for c in rest])


def advance_schedule(registry: DataFrame, attempts: DataFrame) -> DataFrame:
    """The registry after one attempt per source.

    ``attempts`` has ``source_id``, ``attempted_at``, ``http_status``, ``error``, ``items_seen``,
    ``etag``, ``last_modified`` and ``backoff_ms`` (zero unless the host asked for fewer polls). Sources without
    an attempt stay as they are.
    A failure moves ``last_fetched_at`` too, and keeps etag and window size.
    """
    a = attempts.select(
        "source_id",
        F.col("attempted_at").alias("__at"),
        F.col("http_status").alias("__status"),
        F.col("error").alias("__error"),
        F.col("items_seen").alias("__seen"),
        F.col("etag").alias("__etag"),
        F.col("last_modified").alias("__modified"),
        F.col("backoff_ms").alias("__backoff"),
    )
    tried, ok = F.col("__at").isNotNull(), F.col("__error").isNull()
    base = next_fetch_at(
        F.col("__at"), known_zone(F.col("active_hours_tz")), F.col("active_start_hour"),
        F.col("active_end_hour"), F.col("active_interval_min"), F.col("off_interval_min"),
    )
    held_back = F.timestamp_micros(F.unix_micros("__at") + F.col("__backoff") * 1000)
    changed = {
        "next_fetch_at": F.when(
            tried,
            F.when(F.col("__backoff") > 0, F.greatest(base, held_back)).otherwise(base),
        ).otherwise(F.col("next_fetch_at")),
        "last_fetched_at": F.coalesce("__at", "last_fetched_at"),
        "last_etag": F.when(tried & ok, F.coalesce("__etag", "last_etag")).otherwise(F.col("last_etag")),
        "last_modified": F.when(tried & ok, F.coalesce("__modified", "last_modified")).otherwise(
            F.col("last_modified")
        ),
        "feed_window_size": F.when(
            tried & ok & (F.col("__status") != 304), F.coalesce(F.col("__seen").cast("int"), "feed_window_size")
        ).otherwise(F.col("feed_window_size")),
    }
    joined = registry.join(a, "source_id", "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in registry.columns])


def carried_throttles(before: DataFrame, attempts: DataFrame, host: str, tie: str) -> DataFrame:
    """``host`` and ``throttles`` since the last success, after ``attempts`` that follow the state ``before``.

    The history is not read again: what a batch adds to the count of a host, or whether it resets it, is two partial
    aggregates of the batch.
    """
    at = F.struct("attempted_at", tie)
    last = attempts.groupBy(host).agg(F.max(F.when(_succeeded(attempts), at)).alias("last_success"))
    since = (
        attempts.filter(_throttled())
        .select(host, at.alias("at"))
        .join(broadcast_if_small(last), host)
        .filter(F.col("last_success").isNull() | (F.col("at") > F.col("last_success")))
        .groupBy(host)
        .agg(F.count("*").alias("new"))
    )
    known = before.select(F.col("host").alias(host), F.col("throttles").alias("old"))
    joined = last.join(since, host, "left").join(known, host, "full_outer")
    kept = F.when(F.col("last_success").isNull(), F.coalesce("old", F.lit(0))).otherwise(0)
    return joined.select(F.col(host).alias("host"), (kept + F.coalesce("new", F.lit(0))).cast("long").alias("throttles"))


def advance_over_attempts(registry: DataFrame, attempts: DataFrame, tie: str) -> DataFrame:
    """The registry after any number of attempts of each source, as if it had been advanced after each.

    ``attempts`` has ``throttles`` of the host after them all. The last attempt decides the next one; etag and
    modification time are the last that a success brought, the window size that of the last full payload.
    """
    at, ok = F.struct("attempted_at", tie), F.col("error").isNull()

    def last(name: str, when: Column) -> Column:
        return F.max_by(F.when(when, F.col(name)), F.when(when, at)).alias(name)

    folded = attempts.groupBy("source_id").agg(
        F.max("attempted_at").alias("attempted_at"),
        F.max_by(F.struct("http_status"), at).alias("last"),
        last("etag", ok & F.col("etag").isNotNull()),
        last("last_modified", ok & F.col("last_modified").isNotNull()),
        last("items_seen", ok & (F.col("http_status") != 304)),
        F.max("throttles").alias("throttles"),
    )
    # As one attempt that succeeded: what it lacks stays as it was; the backoff follows from the last outcome.
    throttled = F.coalesce(F.col("last")["http_status"].isin(*THROTTLE_STATUSES), F.lit(False))
    held_back = F.when(throttled, backoff_ms(F.col("throttles"))).otherwise(0)
    once = folded.select(
        "source_id", "attempted_at", F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"),
        "items_seen", "etag", "last_modified", held_back.alias("backoff_ms"),
    )
    return advance_schedule(registry, once)
