"""Running values over keys whose rows fill many parts, against a plain loop; late releases; causes of failed audits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyledger.operators import audit, ordered
from storyledger.sources import harvest

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """So few rows would else be put into one part."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


@pytest.fixture(scope="module")
def history(spark):
    """One key with two thirds of all rows, all within one hour, with many ties."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.67 else f"k{rng.randint(0, 9)}"
        rows.append((i, key, START + timedelta(seconds=rng.randint(0, 1800)), rng.random() < 0.3, rng.random() < 0.01))
    return rows, spark.createDataFrame(rows, "id int, key string, at timestamp, hit boolean, reset boolean")


def by_key(rows, order):
    keys = {}
    for row in sorted(rows, key=order):
        keys.setdefault(row[1], []).append(row)
    return keys


def test_hits_since_reset(spark, history):
    rows, frame = history
    want = {}
    for own in by_key(rows, lambda r: (r[2], r[0])).values():
        n = 0
        for i, _, _, hit, reset in own:
            # A reset row's own hit is before the reset.
            n = 0 if reset else n + hit
            want[i] = n
    got = ordered.hits_since_reset(frame, "key", "at", "id", F.col("hit"), F.col("reset"), "n")
    assert {r.id: r.n for r in got.collect()} == want
    assert got.columns == [*frame.columns, "n"]


@pytest.mark.parametrize("strict", [True, False])
def test_next_event(spark, history, strict):
    rows, frame = history
    times = {k: [r[2] for r in own if r[4]] for k, own in by_key(rows, lambda r: r[2]).items()}
    got = ordered.next_event(frame, "key", "at", F.col("reset"), "then", strict=strict)
    for r in got.where("not reset").collect():
        after = [t for t in times[r.key] if t > r.at or (t == r.at and not strict)]
        assert r.then == (min(after) if after else None)


def test_next_event_folds_each_row_once(spark, history, capsys):
    """A frame that ends where its window ends is folded anew for every row, which is quadratic in the rows of a key."""
    ordered.next_event(history[1], "key", "at", F.col("reset"), "then").explain()
    plan = capsys.readouterr().out.lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_a_hot_key_within_an_hour_fills_many_parts(spark, history):
    _, frame = history
    parts = ordered.ranged_parts(frame.where("key = 'hot'"), "key", "at", "id")
    sizes = [r["count"] for r in parts.groupBy("__part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    assert ordered.hits_since_reset(frame.limit(0), "key", "at", "id", F.col("hit"), F.col("reset"), "n").count() == 0


def test_late_releases(spark):
    day = timedelta(days=1)
    calendar = spark.createDataFrame(
        [("a", START, 2160), ("a", START + 40 * day, 24), ("b", START, 2), ("b", START + day, 2), ("c", START, 5), ("a", START + 900 * day, 1)],
        "source_id string, due_at timestamp, window_hours int",
    )
    docs = spark.createDataFrame(
        [("a", START + 39 * day), ("b", START), ("b", START + day + timedelta(hours=3)), ("z", START), ("c", None)], "source_id string, fetched_at timestamp"
    )
    late = audit.calendar_overdue(calendar, docs, F.lit(START + 100 * day))
    assert sorted((r.source_id, r.due_at) for r in late.collect()) == [("a", START + 40 * day), ("b", START + day), ("c", START)]
    assert late.columns == calendar.columns


def test_undelivered_index_pages_are_the_cause(spark):
    registry = spark.createDataFrame(
        [(s, "https://x.example/i", None, "/A/", False, "index_diff", True, "finance", "news") for s in "abc"],
        "source_id string, index_url string, feed_url string, index_link_pattern string, lowercase_url_path boolean,"
        " audit_strategy string, is_active boolean, vertical string, source_kind string",
    )
    body = '<a href="/A/1">a headline that is long enough to count</a>'
    pages = spark.createDataFrame(
        [("a", 200, body), ("a", 503, "busy"), ("b", 503, body), ("c", None, ""), ("c", 200, "<p>moved</p>")],
        "source_id string, http_status int, body string",
    )
    held = spark.createDataFrame([("https://x.example/A/1",)], "url string")
    found = harvest.scrape_pages(pages, registry)
    rows = {r.source_id: r for r in audit.audit_index_diff(found, held, registry).collect()}
    assert (rows["a"].status, rows["a"].expected_count, rows["a"].ingested_count) == ("error", 1, 1)
    assert "http" in rows["a"].detail and rows["b"].detail == "the index page returned HTTP 503"
    assert rows["c"].detail == "the index page could not be fetched"
