import json
import os

import pytest
from pyspark.sql import functions as F

from storyledger.catalog import bindings, queries
from storyledger.plans import ingest
from storyledger.sources import apis, feeds, harvest, payloads, registry

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>C</title>
<item><title> First &amp; best </title><link>https://a.example.com/1</link><pubDate>Mon, 17 Aug 2026 20:30:00 +0530</pubDate><dc:creator>Desk</dc:creator><description>&lt;p&gt;One&lt;/p&gt;&lt;p&gt;Two &amp;amp; three&lt;/p&gt;</description>
<media:content url="s.jpg" width="100"/><media:content url="l.jpg" width="900" medium="image"/><media:content url="v.mp4" medium="video"/><media:thumbnail url="t.jpg"/></item>
<item><guid>opaque-1</guid><title>no link</title></item>
<item><guid>https://a.example.com/2</guid><enclosure url="a.mp3" type="audio/mpeg"/><content:encoded>&lt;img src="/track?x"&gt;&lt;img src="/media/x.png"&gt;</content:encoded></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">E1</title><link rel="self" href="https://b.example.com/self"/><link rel="alternate" href="https://b.example.com/1"/><updated>2026-08-17T00:00:00Z</updated><author><name>Ann</name></author></entry></feed>"""
STORIES = json.dumps({"hits": [{"objectID": "7", "title": " T ", "url": "https://c.example.com/x", "created_at": "2026-08-17T00:00:00Z"}, {"title": "no id"}, {"objectID": "8", "title": "Ask", "url": None}]})
RELEASES = json.dumps([{"html_url": "https://g.example.com/r/1", "name": " ", "tag_name": "v1", "draft": False, "body": " b "}, {"html_url": "https://g.example.com/r/2", "draft": True}, {"html_url": None}, {"html_url": "https://g.example.com/r/3", "prerelease": True}])
INDEX = """<html><body><nav><a href="/about/">About this very long institution name</a></nav><!-- <a href="/doc/0">A commented link that must not be counted</a> -->
<a href="/doc/1">A circular about something   important &amp; long</a><a href="https://sub.i.example.com/doc/2?x=1&amp;y=2">Another circular of the same institution</a>
<a href="/doc/1">A circular about something important again</a><a href="https://elsewhere.example.net/doc/3">A circular on a different site altogether</a>
<a href="#top">Back to the very top of the page, please</a><a href="mailto:x@y.z">Write to the press office of this site</a><a href="/doc/4">Short</a><a href="/doc/file.zip">An archive of all documents of the year</a>
<a href="/about-consumer-affairs">Consumer affairs and everything about them</a></body></html>"""


def landed(spark, rows):
    schema = "pull_id string, source_id string, part string, part_no int, fetch_type string, http_status int, body string"
    frame = spark.createDataFrame([(f"p{i}", f"s{i}", *r) for i, r in enumerate(rows)], schema)
    return frame.withColumn("fetched_at", F.lit("2026-08-18").cast("timestamp"))


def test_rss(spark):
    items = feeds.with_url(feeds.rss_items(landed(spark, [(None, 0, "rss", 200, RSS)]))).orderBy("pos").collect()
    first, second = items
    assert (first.url_raw, first.title, first.author) == ("https://a.example.com/1", "First & best", "Desk")
    assert first.summary == "One\nTwo & three"
    assert [(c.url, c.source) for c in first.image_candidates] == [("s.jpg", "media_content"), ("l.jpg", "media_content"), ("t.jpg", "media_thumbnail")]
    assert second.url_raw == "https://a.example.com/2"
    assert [(c.url, c.source) for c in second.image_candidates] == [("/media/x.png", "content_img")]


def test_atom(spark):
    (entry,) = feeds.atom_items(landed(spark, [(None, 0, "atom", 200, ATOM)])).collect()
    assert (entry.url_raw, entry.title, entry.author, entry.published_at_raw) == ("https://b.example.com/1", "E1", "Ann", "2026-08-17T00:00:00Z")


def test_json_items(spark):
    stories = apis.story_items(landed(spark, [(None, 0, "hn", 200, STORIES)])).orderBy("pos").collect()
    assert [(s.url_raw[-5:], s.title, s.discovery_target_url) for s in stories] == [("?id=7", "T", "https://c.example.com/x"), ("?id=8", "Ask", None)]
    rows = apis.release_items(landed(spark, [("o/r", 0, "github_api", 200, RELEASES)])).orderBy("pos").collect()
    assert [(r.title, r.summary) for r in rows] == [("o/r v1", "b"), ("o/r release", None)]


def test_harvest(spark):
    page = spark.createDataFrame([(1, "https://www.i.example.com/index", INDEX)], "id int, page_url string, body string")
    links = harvest.harvest_links(page).first().links
    assert [(k.url, k.title) for k in links] == [
        ("https://www.i.example.com/doc/1", "A circular about something important & long"),
        ("https://sub.i.example.com/doc/2?x=1&y=2", "Another circular of the same institution"),
        ("https://www.i.example.com/about-consumer-affairs", "Consumer affairs and everything about them"),
    ]
    only = harvest.harvest_links(page, pattern=F.lit(r"/doc/\d")).first().links
    assert len(only) == 2
    assert len(harvest.harvest_links(page, max_links=1).first().links) == 1
    many = "".join(f'<a href="/doc/{i}">A circular about something, number {i}</a>' for i in range(1000))
    long = spark.createDataFrame([(1, "https://www.i.example.com/index", many)], "id int, page_url string, body string")
    assert len(harvest.harvest_links(long).first().links) == 1000
    bad = spark.createDataFrame([(1, "no url", INDEX)], "id int, page_url string, body string")
    assert not harvest.harvest_links(bad).first().page_ok


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(f"s{i}", f"s{i}", f"https://www.i{i}.example.com/feed", None if i == 5 else "/doc/") for i in range(20)]
    return registry.with_defaults(spark.createDataFrame(rows, "source_id string, slug string, feed_url string, index_link_pattern string"))


def test_payload_errors(spark, sources):
    cases = [
        ("rss", 304, "", None),
        ("rss", 200, "<html><body>x</body></html>", "parse"),
        ("rss", 503, "", "http"),
        ("rss", 200, " \n ", "empty-body"),
        ("rss", None, None, "network"),
        ("scrape", 200, INDEX, "no-pattern"),
        ("scrape", 200, "<html></html>", "layout"),
        ("hn", 200, "not json", "parse"),
        ("hn", 200, "{}", "schema"),
        ("json_api", 200, "{}", "unsupported-fetch-type"),
        ("github_api", 200, "{}", "github"),
        ("rss", 200, RSS.replace("<link>https://a.example.com/1</link>", "").replace("<guid>https://a.example.com/2</guid>", ""), "no-urls"),
        ("rss", 200, RSS, None),
    ]
    frame = landed(spark, [(None, 0, kind, status, body) for kind, status, body, _ in cases])
    got = {r.source_id: r.error_kind for r in ingest.payload_errors(frame, sources).collect()}
    assert got == {f"s{i}": c[3] for i, c in enumerate(cases) if c[3]}
    kinds = {r.source_id: r.payload_status for r in payloads.classify(frame).collect()}
    assert kinds["s0"] == "not_modified" and kinds["s2"] == "error" and kinds["s12"] == "ok"


def test_partial_release_failure_is_no_error(spark):
    frame = landed(spark, [("o/a", 0, "github_api", 200, RELEASES), ("o/b", 1, "github_api", 500, "")])
    frame = frame.withColumn("pull_id", F.lit("p")).withColumn("source_id", F.lit("s"))
    ok = F.when(F.col("payload_status") == "ok", F.col("body"))
    parsed = payloads.classify(frame).withColumn("releases", apis.parsed_releases(ok))
    assert apis.release_errors(parsed).count() == 0
    assert apis.release_errors(parsed.filter("part_no = 1")).count() == 1


def test_latest_capture_of_a_page(spark):
    rows = [("u", 200, "old", 1), ("u", 404, "", 3), ("u", 200, "new", 2), ("v", 200, "only", 1), ("w", 200, "not asked", 1)]
    pages = spark.createDataFrame(rows, "url string, page_status int, page_body string, at int").withColumn("captured_at", F.timestamp_seconds("at"))
    asked = spark.createDataFrame([("u",), ("v",), ("x",)], "url string")
    got = sorted(tuple(r) for r in ingest.latest_captures(pages, asked).collect())
    assert got == [("u", 404, ""), ("v", 200, "only")]


def test_one_parse_feeds_items_and_errors(spark, sources):
    frame = landed(spark, [(None, 0, "rss", 200, RSS), (None, 0, "hn", 200, "{}"), (None, 0, "scrape", 200, INDEX)])
    parsed = ingest.parse_payloads(frame, sources)
    for result in (ingest.items_of(parsed), ingest.errors_of(parsed)):
        plan = result._jdf.queryExecution().toString()
        assert "from_xml" not in plan and "xmltostructs" not in plan.lower()
    assert ingest.items_of(parsed).groupBy("source_id").count().count() == 2
    assert [r.error_kind for r in ingest.errors_of(parsed).collect()] == ["schema"]
    assert ingest.items_of(ingest.parse_payloads(frame.limit(0), sources)).count() == 0


def test_registry(spark, sources, tmp_path):
    (tmp_path / "seed.json").write_text('{"slug":"x","name":"X","vertical":"tech","source_type":"outlet","fetch_type":"rss","feed_url":"https://x.example.com/f"}\n')
    row = registry.load_registry(spark, str(tmp_path / "seed.json")).first()
    assert (row.source_kind, row.active_hours_tz, row.off_interval_min, row.topics, row.is_active) == ("news", "Asia/Kolkata", 120, [], True)
    with pytest.raises(ValueError, match='duplicate slug "s0"'):
        registry.assert_unique_slugs(sources.unionByName(sources.filter("slug = 's0'")))


def test_payloads_of_one_source_fill_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "en", "src1") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    class Batch:
        """Stands for a run of the stream, and counts the files that it finds."""

        def __init__(self, stream, store, *_):
            folder = f"{os.path.dirname(store.root)}/in"
            seen.append(len([f for f in os.listdir(folder) if f.endswith(".parquet")]))

        def awaitTermination(self):  # noqa: N802
            pass

    monkeypatch.setattr(queries.jobs, "stream_bookkeeping", Batch)
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    for name, value in zip(names, ("false", "-1"), strict=True):
        spark.conf.set(name, value)
    try:
        parts = bindings.payloads(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        queries._settled(spark, str(tmp_path))
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sum(r["count"] for r in parts) == 40 and len(parts) > 1
    assert len(seen) == queries.BATCHES and seen[-1] > queries.BATCHES
