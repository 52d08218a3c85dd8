import itertools
import random

from pyspark.sql import functions as F

from storyledger.operators import audit, identity, merge, ordered, provenance, schedule, validate
from storyledger.sources.tables import read_table, write_table


def ts(text):
    return F.lit(text).cast("timestamp")


def test_first_per_key_and_page_marks(spark):
    rows = [("p", f"u{i % 40}", i) for i in range(200)] + [("q", "u1", 5)]
    items = spark.createDataFrame(rows, "pull_id string, url string, pos long")
    unique = identity.dedup_within_pull(items)
    assert unique.count() == 41 and unique.agg(F.max("pos")).first()[0] == 39
    held = spark.createDataFrame([("u0",), ("u1",)], "url string")
    for small in (False, True):
        fresh = identity.not_held(unique, held, small_batch=small)
        assert fresh.count() == 38
    assert identity.mark_pages_to_fetch(fresh, F.lit("record")).filter("fetch_page").count() == 38
    marked = identity.mark_pages_to_fetch(fresh, F.lit("record"), 25)
    assert sorted(r.pos for r in marked.filter("fetch_page").collect()) == list(range(2, 27))
    assert identity.mark_pages_to_fetch(fresh, F.lit("discovery")).filter("fetch_page").count() == 0


def brute_throttles(rows):
    out, state = {}, {}
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        n = 0
        for _, at, i, status in group:
            n = 0 if status == 200 else n + (status in (429, 503))
            out[i] = n
        state[key] = n
    return out, state


def test_throttle_history_matches_a_loop(spark):
    rng = random.Random(5)
    # One host holds most rows, over several hours, with ties in time.
    rows = [("hot" if rng.random() < 0.7 else f"h{rng.randrange(4)}", rng.randrange(6 * 3600) // 7, i, rng.choice([200, 503, 503, 429, 404, 404])) for i in range(600)]
    log = spark.createDataFrame(rows, "host string, s long, id long, http_status int").select(
        "host", F.timestamp_seconds("s").alias("attempted_at"), "id", "http_status", F.when(F.col("http_status") != 200, "x").alias("error")
    )
    history, state = brute_throttles(rows)
    got = {r.id: r.throttles for r in schedule.throttle_history(log, "host", "id").collect()}
    assert got == history
    unique = log.dropDuplicates(["host", "attempted_at"])
    kept = [(r.host, r.attempted_at, r.id, r.http_status) for r in unique.collect()]
    _, state = brute_throttles(kept)
    again = spark.createDataFrame(kept, "host string, attempted_at timestamp, id long, http_status int").withColumn("error", F.when(F.col("http_status") != 200, "x"))
    assert {r.host: r.throttles for r in schedule.throttle_state(again).collect()} == state


def test_backoff_grows_and_stops(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 8, 9, 500)], "n int")
    assert [r.b for r in rows.select(schedule.backoff_ms(F.col("n")).alias("b")).collect()] == [0, 2000, 4000, 256000, 300000, 300000]


def test_resolution_is_strictly_later(spark):
    rng = random.Random(6)
    fails = [(f"s{rng.randrange(2)}", rng.randrange(20_000), i) for i in range(200)]
    wins = [(f"s{rng.randrange(2)}", rng.randrange(18_000)) for _ in range(40)]
    errors = spark.createDataFrame(fails, "source_id string, s long, message long").select(
        "source_id", "message", F.timestamp_seconds("s").alias("occurred_at"), F.lit(None).cast("timestamp").alias("resolved_at")
    )
    log = spark.createDataFrame(wins, "source_id string, s long").select(
        "source_id", F.timestamp_seconds("s").alias("attempted_at"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error")
    )
    got = {r.message: r.at for r in merge.resolve_open_errors(errors, log).select("message", F.unix_seconds("resolved_at").alias("at")).collect()}
    want = {i: min((w for k, w in wins if k == key and w > s), default=None) for key, s, i in fails}
    assert got == want


def test_insert_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2)], "url string, pos int").withColumn("fetched_at", ts("2026-01-01"))
    root = str(tmp_path)
    write_table(merge.insert_if_absent(docs, docs.limit(0), "pos"), root, "raw_documents")
    held = spark.read.parquet(f"{root}/raw_documents")
    assert merge.insert_if_absent(docs, held, "pos").count() == 0
    assert sorted((r.url, r.pos) for r in held.collect()) == [("a", 0), ("b", 2)]


def test_retention_in_place(spark, tmp_path):
    rows = [("old", "2026-01-01 10:00:00"), ("mid", "2026-01-08 10:00:00"), ("new", "2026-01-10 09:00:00")]
    docs = spark.createDataFrame(rows, "url string, at string").select(
        "url", F.lit("text").alias("text_content"), F.lit("html").alias("html_snapshot"), F.col("at").cast("timestamp").alias("fetched_at")
    )
    root, asof = str(tmp_path), ts("2026-01-10 12:00:00")
    write_table(docs, root, "raw_documents")
    assert merge.retention_debt(docs, asof).first()[0] == 2
    merge.retain_stored(spark, root, asof)
    kept = read_table(spark, root, "raw_documents")
    assert sorted((r.url, r.text_content, r.html_snapshot) for r in kept.collect()) == [("mid", "text", None), ("new", "text", "html"), ("old", None, None)]
    assert merge.retention_debt(kept, asof).first()[0] == 0


def test_upsert_registry_keeps_runtime_state(spark):
    schema = "slug string, name string, notes string, last_etag string, updated_at timestamp"
    current = spark.createDataFrame([("a", "A", "n", "e1", None), ("gone", "G", None, "e2", None)], schema)
    seed = spark.createDataFrame([("a", "A2", None, "zz", None), ("new", "N", "x", None, None)], schema)
    got = {r.slug: (r.name, r.notes, r.last_etag) for r in merge.upsert_registry(current, seed, ts("2026-01-01")).collect()}
    assert got == {"a": ("A2", None, "e1"), "gone": ("G", None, "e2"), "new": ("N", "x", None)}


def test_purge_looks_at_paths_only(spark):
    docs = spark.createDataFrame([("s", "https://x/A"), ("s", "https://x/a?Q=1"), ("t", "https://x/A"), ("s", "odd")], "source_id string, url string")
    sources = spark.createDataFrame([("s", True), ("t", False)], "source_id string, lowercase_url_path boolean")
    assert sorted(r.url for r in merge.purge_stale_urls(docs, sources).collect()) == ["https://x/A", "https://x/a?Q=1", "odd"]
    assert [r.url for r in merge.stale_urls(docs, sources).collect()] == ["https://x/A"]


def test_audit_counts_before_the_cap(spark):
    expected = spark.createDataFrame([("s", f"u{i:03}", i) for i in range(120)] + [("s", "u005", 999), ("t", "u1", 0)], "source_id string, url string, pos long")
    held = spark.createDataFrame([(f"u{i:03}",) for i in range(0, 120, 2)] + [("u1",)], "url string")
    got = {r.source_id: r for r in audit.compare_with_held(expected, held).collect()}
    row = got["s"]
    assert (row.expected_count, row.ingested_count, len(row.missing_urls)) == (120, 60, 50)
    assert row.missing_urls[:2] == ["u001", "u003"] and got["t"].missing_urls == []


def test_streaks_and_overdue(spark):
    days = [("finance", d, "ok" if d not in (4,) else "gap") for d in (1, 2, 3, 4, 5, 7)]
    audits = spark.createDataFrame(days, "vertical string, d int, status string").select("vertical", F.make_date(F.lit(2026), F.lit(1), F.col("d")).alias("audit_date"), "status")
    got = sorted((str(r.first_day), r.clean_days) for r in audit.clean_streak(audits).collect())
    assert got == [("2026-01-01", 3), ("2026-01-05", 1), ("2026-01-07", 1)]
    due = spark.createDataFrame([("s", "2026-01-01 12:30:00", 2), ("s", "2026-01-02 12:30:00", 2)], "source_id string, at string, window_hours int").select("source_id", F.col("at").cast("timestamp").alias("due_at"), "window_hours")
    docs = spark.createDataFrame([("s", "2026-01-01 14:30:00"), ("s", "2026-01-02 12:29:00")], "source_id string, at string").select("source_id", F.col("at").cast("timestamp").alias("fetched_at"))
    assert [str(r.due_at) for r in audit.calendar_overdue(due, docs, ts("2026-02-01")).collect()] == ["2026-01-02 12:30:00"]


def test_validation(spark):
    table = spark.createDataFrame([("a", "finance", "news"), ("a", "sport", None)], "slug string, vertical string, source_kind string")
    assert [(r.column_name, r.value, r.n) for r in validate.enum_violations(table, "sources").collect()] == [("vertical", "sport", 1)]
    assert [(r.key_value, r.n) for r in validate.unique_violations(table, "sources").collect()] == [("a", 2)]


def test_independent_sources(spark):
    rows = [
        ("st", "s1", "record", None, None), ("st", "s1", "record", None, None), ("st", "s2", "record", "PTI", "byline"),
        ("st", "s3", "record", "PTI", "dateline"), ("st", "s4", "record", "PTI", "mention"), ("st", "s5", "discovery", None, None),
    ]
    docs = spark.createDataFrame(rows, "story string, source_id string, source_role string, wire_agency string, wire_evidence string")
    row = provenance.independent_sources(docs, "story").first()
    assert (row.independent_sources, row.documents, row.wire_copies, row.discovery_documents) == (3, 6, 2, 1)


def test_stored_retention_keeps_every_column_and_row(spark, tmp_path):
    from storyledger.operators.merge import retain_stored

    row = ("d1", 7, "http://a/1", "text", "<p>", "2024-01-01 00:00:00")
    names = "document_id string, pull_id bigint, url string, text_content string, html_snapshot string, fetched_at string"
    docs = spark.createDataFrame([row, ("d2", 8, "http://a/2", "text", "<p>", "2024-01-30 20:00:00")], names)
    docs = docs.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("fetch_date", F.to_date("fetched_at"))
    docs.write.partitionBy("fetch_date").parquet(f"{tmp_path}/raw_documents")
    retain_stored(spark, str(tmp_path), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    after = spark.read.parquet(f"{tmp_path}/raw_documents")
    assert sorted(after.columns) == sorted(docs.columns)
    got = {r.document_id: (r.pull_id, r.text_content, r.html_snapshot) for r in after.collect()}
    assert got == {"d1": (7, None, None), "d2": (8, "text", "<p>")}
