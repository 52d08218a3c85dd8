"""The versioned store: whole versions or none, and an index of which a batch opens its own buckets."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyledger.catalog import bindings as B
from storyledger.limits import POLLER_LIMITS
from storyledger.plans import bookkeeping, marts, rollups
from storyledger.session import landed
from storyledger.sources.store import Store

SF_DIR = "/root/testdata/sf0.001"


def urls(spark, numbers):
    return spark.createDataFrame([(f"https://x.example/{i}",) for i in numbers], "url string")


def test_held_urls_after_many_versions(spark, tmp_path):
    store = Store(f"{tmp_path}/s", n=4, fanout=3)
    known = set()
    for version in range(14):
        new = range(version * 5, version * 5 + 5)
        store.commit(spark, version, urls(spark, new), {}, {})
        known |= set(new)
        asked = urls(spark, [0, 7, version * 5, 10_000])
        held = {r.url for r in store.held(spark, asked, version).collect()}
        bucket = {r.url: r.b for r in urls(spark, sorted(known)).withColumn("b", store.bucket(F.col("url"))).collect()}
        mine = {r.b for r in asked.select(store.bucket(F.col("url")).alias("b")).collect()}
        assert held == {u for u, b in bucket.items() if b in mine}
        # Runs of a bucket grow with the logarithm of the versions, and none is read twice.
        live = store.runs(spark, version)
        assert all(len(runs) <= 2 * 3 and max(Counter(level for _, level in runs).values()) < 3 for runs in live.values())
    assert store.latest(spark) == 13
    assert store.held(spark, urls(spark, []), 13).count() == 0


def test_a_version_without_its_manifest_does_not_count(spark, tmp_path):
    store = Store(f"{tmp_path}/s", n=2)
    rows = urls(spark, [1, 2]).withColumn("fetch_date", F.to_date(F.lit("2024-01-01")))
    store.commit(spark, 0, rows.select("url"), {"raw_documents": rows}, {"sources": rows})
    # A failed try of version 1 leaves rows, an index run, and no manifest.
    rows.write.partitionBy("fetch_date").parquet(f"{store.root}/raw_documents/version=1")
    urls(spark, [3]).withColumn("bucket", store.bucket(F.col("url"))).write.partitionBy("bucket").parquet(f"{store.root}/urls/run=1")
    assert store.latest(spark) == 0 and store.runs(spark, 1) is None
    assert store.read(spark, "raw_documents", None, 0).count() == 2
    assert {r.url for r in store.held(spark, urls(spark, range(9)), 0).collect()} == {"https://x.example/1", "https://x.example/2"}
    other = urls(spark, [4]).withColumn("fetch_date", F.to_date(F.lit("2024-01-02")))
    store.commit(spark, 1, other.select("url"), {"raw_documents": other}, {"sources": other})
    assert {r.url[-1] for r in store.read(spark, "raw_documents", None, 1).collect()} == {"1", "2", "4"}
    assert store.read_whole(spark, "sources", 0).count() == 2 and store.read_whole(spark, "sources", 1).count() == 1


@pytest.mark.parametrize("asof", ["2024-01-31 00:00:00", "2024-01-30 10:20:30"])
def test_health_from_partial_aggregates(spark, asof):
    if not os.path.isdir(SF_DIR):
        pytest.skip("benchmark tables are not here")
    at = F.lit(asof).cast("timestamp")
    spread = F.timestamp_micros(F.unix_micros("fetched_at") - F.col("doc_id") * 61_000_000)
    docs = landed(B.raw_documents(spark, SF_DIR).withColumn("fetched_at", spread).withColumn("fetch_date", F.to_date("fetched_at")), "docs")
    log, errors, registry = B.fetch_log(spark, SF_DIR), B.source_errors(spark, SF_DIR), B.registry(spark, SF_DIR)
    hours = [rollups.document_hours(docs.where(F.col("doc_id") % 2 == i)) for i in (0, 1)]
    polls = [rollups.log_hours(log.where(F.col("event_id") % 2 == i)) for i in (0, 1)]
    whole = marts.source_health(registry, docs, log, errors, at)
    rolled = rollups.source_health(registry, hours[0].union(hours[1]), polls[0].union(polls[1]), docs, log, errors, at)
    assert sorted(map(str, rolled.collect())) == sorted(map(str, whole.collect()))
    assert rollups.totals(registry, hours[0].union(hours[1]), docs, errors, at).collect() == marts.totals(registry, docs, errors, at).collect()


@pytest.fixture(scope="module")
def inputs(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("benchmark tables are not here")
    return landed(B.payloads(spark, SF_DIR), "payloads"), landed(B.landed_pages(spark, SF_DIR), "pages"), landed(B.registry(spark, SF_DIR), "registry")


def tables(spark, store, version):
    whole = [store.read_whole(spark, n, version) for n in ("sources", "open_errors", "throttles")]
    added = [store.read(spark, n, None, version).drop("version") for n in ("raw_documents", "fetch_log", "source_errors")]
    return [sorted(map(str, frame.collect())) for frame in whole + added]


def test_replays_and_batches_do_not_matter(spark, tmp_path, inputs):
    payloads, pages, registry = inputs
    none = spark.createDataFrame([], "url string")
    cut = F.col("fetched_at") < F.lit("2024-01-25").cast("timestamp")
    parts = [landed(payloads.where(cut), "early"), landed(payloads.where(~cut), "late")]
    once, twice = Store(f"{tmp_path}/once", n=4), Store(f"{tmp_path}/twice", n=4)
    for store in (once, twice):
        bookkeeping.found(spark, store, registry, none)
    assert bookkeeping.settle_into(spark, once, 1, payloads, pages, POLLER_LIMITS)
    for version, part in enumerate(parts, 1):
        assert bookkeeping.settle_into(spark, twice, version, part, pages, POLLER_LIMITS)
        assert not bookkeeping.settle_into(spark, twice, version, part, pages, POLLER_LIMITS)
    assert tables(spark, once, 1) == tables(spark, twice, 2)
    # All payloads again: every document is held, the log grows, and no error is closed twice.
    before = tables(spark, once, 1)
    assert bookkeeping.settle_into(spark, once, 2, payloads, pages, POLLER_LIMITS)
    after = tables(spark, once, 2)
    assert after[3] == before[3] and len(after[4]) == 2 * len(before[4]) and after[0] == before[0]
