from pyspark.sql import functions as F

from storyledger.functions import times
from storyledger.functions.claims import claim, corroboration
from storyledger.functions.images import first_image_in_html, is_junk_image, parse_dimension, select_lead_image
from storyledger.functions.text import snippet
from storyledger.functions.wire import has_verbatim_quote, with_wire

FETCHED = "2026-08-18 00:00:00"


def test_published_times(spark):
    cases = [
        ("Mon, 17 Aug 2026 20:30:00 +0530", "2026-08-17 15:00:00", "high"),
        ("17 Aug 2026 20:30 EST", "2026-08-18 01:30:00", "high"),
        ("2026-08-17T22:15:00Z", "2026-08-17 22:15:00", "high"),
        ("2026-08-17T22:15:00.250+02:00", "2026-08-17 20:15:00.25", "high"),
        ("Mon, 17 Aug 2026 20:30:00 GMT (Greenwich)", "2026-08-17 20:30:00", "high"),
        ("2026-08-17 20:30:00", "2026-08-17 20:30:00", "low"),
        ("August 17, 2026", "2026-08-17 00:00:00", "low"),
        # The year reads like an offset, so this counts as zoned.
        ("17-Aug-2026", "2026-08-17 00:00:00", "high"),
        ("2026-08-18T10:00:00Z", "2026-08-18 10:00:00", "suspect"),
        ("2026-08-18T01:00:00Z", "2026-08-18 01:00:00", "high"),
        ("2026-08-18T02:00:00Z", "2026-08-18 02:00:00", "high"),
        ("2026-01-05T09:00:00Z", "2026-01-05 09:00:00", "suspect"),
        ("Mon, 17 Aug 2026 20:30:00 IST", FETCHED, "low"),
        ("2026-13-40", FETCHED, "low"),
        ("Aug 17, 2026 3:05 PM GMT", "2026-08-17 15:05:00", "high"),
        ("Mon, Aug 17, 2026 12:05 a.m. EST", "2026-08-17 05:05:00", "high"),
        ("17 Aug 26 10:00:00 GMT", "2026-08-17 10:00:00", "high"),
        ("08/17/2026", "2026-08-17 00:00:00", "low"),
        ("8/17/26 11:30:15 pm +0000", "2026-08-17 23:30:15", "high"),
        ("17/08/2026", FETCHED, "low"),
        ("08/17/2026 13:05 PM", FETCHED, "low"),
        ("30 Jan 99", "1999-01-30 00:00:00", "suspect"),
        ("not a date", FETCHED, "low"),
        ("  ", FETCHED, "low"),
        (None, FETCHED, "low"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, published_at_raw string")
    rows = rows.withColumn("fetched_at", F.lit(FETCHED).cast("timestamp"))
    got = times.with_published(rows).orderBy("i").select(F.col("published_at").cast("string").alias("at"), "published_at_confidence", "published_at_reason").collect()
    assert [(c[0], g.at, g.published_at_confidence) for c, g in zip(cases, got)] == cases
    assert got[8].published_at_reason == "published date is 10h ahead, in the future"
    assert "225d old" in got[11].published_at_reason
    assert got[22].published_at_reason == 'unparseable: "not a date", so the fetch time stands in'


def test_active_hours(spark):
    cases = [
        ("2026-08-17 05:00:00", "Asia/Kolkata", 9, 19, True),
        ("2026-08-17 14:00:00", "Asia/Kolkata", 9, 19, False),
        ("2026-08-17 23:00:00", "UTC", 22, 6, True),
        ("2026-08-17 12:00:00", "UTC", 22, 6, False),
        ("2026-08-17 12:00:00", "UTC", 0, 0, True),
        ("2026-08-17 10:00:00", "Not/AZone", 9, 11, True),
    ]
    rows = spark.createDataFrame(cases, "at string, tz string, a int, b int, want boolean")
    got = rows.select("want", times.is_active_hour(F.col("at").cast("timestamp"), times.known_zone(F.col("tz")), F.col("a"), F.col("b")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_ages(spark):
    rows = spark.createDataFrame([("2026-01-01 00:00:00",), ("2025-12-31 23:31:00",), ("2025-12-30 12:00:00",), (None,)], "at string")
    asof = F.lit("2026-01-01 00:00:10").cast("timestamp")
    at = F.col("at").cast("timestamp")
    got = rows.select(times.age_text(at, asof).alias("a"), times.age_text(at, asof, days_from_hours=24).alias("b")).collect()
    assert [r.a for r in got] == ["just now", "29m ago", "36h ago", "never"]
    assert got[2].b == "2d ago"


def test_claims(spark):
    texts = [
        "according to unnamed sources", "sources said on Monday", "people familiar with the deal", "spoke on condition of anonymity",
        "who didn't wish to be named", "declined to be identified", "industry  sources expect",
    ]
    rows = [("record", "outlet", t, "rumoured") for t in texts]
    rows += [
        ("record", "wire", "resources said", "reported"),
        ("record", "outlet", None, "reported"),
        ("record", "regulator", "sources said", "announced"),
        ("record", "company_blog", "", "announced"),
        ("record", "analyst_blog", "", "speculated"),
        ("record", "community", "", None),
        ("discovery", "outlet", "sources said", None),
    ]
    frame = spark.createDataFrame(rows, "role string, kind string, text string, want string")
    got = frame.select("text", "want", claim(F.col("role"), F.col("kind"), F.col("text")).alias("v")).collect()
    assert [(r.text, r.v.claim_type) for r in got] == [(r.text, r.want) for r in got]
    assert got[1].v.claim_reason == 'unnamed sources: "sources said"'


def test_wire(spark):
    cases = [
        ("PTI", None, "PTI", "byline"),
        (" AP ", None, "AP", "byline"),
        (None, "(AP) said", None, None),
        (None, "NEW DELHI (Reuters) — text", "Reuters", "dateline"),
        (None, "With inputs from ANI the story", "ANI", "byline"),
        (None, "Press Trust of India reports", "PTI", "dateline"),
        # Agencies are tried in list order, not in text order.
        (None, "Reuters and PTI", "PTI", "dateline"),
        (None, "x" * 401 + " Bloomberg", "Bloomberg", "mention"),
        ("A Writer", "no agency in the COMPANION", None, None),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, byline string, body string")
    got = with_wire(rows, byline=F.col("byline"), body=F.col("body")).orderBy("i").collect()
    assert [(r.wire_agency, r.wire_evidence) for r in got] == [c[2:] for c in cases]
    skipped = with_wire(rows, byline=F.col("byline"), body=F.col("body"), skip=F.lit(True))
    assert skipped.filter("wire_agency IS NOT NULL").count() == 0


def test_corroboration_and_quotes(spark):
    rows = spark.createDataFrame([("record", None), ("record", "byline"), ("record", "mention"), ("discovery", None)], "role string, e string")
    got = rows.select(corroboration(F.col("role"), F.lit("PTI"), F.col("e"))["counts"].alias("c")).collect()
    assert [r.c for r in got] == [True, False, True, False]
    quotes = spark.createDataFrame([(["x" * 250],), (["short", " " * 300],), ([],), (None,)], "q array<string>")
    assert [r.v for r in quotes.select(has_verbatim_quote(F.col("q")).alias("v")).collect()] == [True, False, False, False]


def test_images(spark):
    sizes = spark.createDataFrame([("640",), ("640px",), ("640.5",), ("auto",), ("0",), ("-5",), (None,)], "v string")
    assert [r.d for r in sizes.select(parse_dimension(F.col("v")).alias("d")).collect()] == [640, 640, 641, None, None, None, None]
    junk = spark.createDataFrame([("https://x/1x1.gif", True), ("https://x/a/logo-big.png", True), ("https://x/spriteful.png", False)], "u string, want boolean")
    assert all(r.want == r.got for r in junk.select("want", is_junk_image(F.col("u")).alias("got")).collect())
    page = "https://s.example.com/a/b"
    cases = [
        ([("t.jpg", "media_content", "300"), ("w.jpg", "media_content", "900"), ("o.jpg", "og", "4000")], ("https://s.example.com/a/w.jpg", 900)),
        ([("/pixel.gif", "media_content", None), ("/ok.jpg", "og", None)], ("https://s.example.com/ok.jpg", None)),
        ([("/small.jpg", "og", "64")], None),
        ([("data:image/png;base64,x", "og", None), ("Photo unavailable", "og", None)], None),
        ([], None),
    ]
    rows = spark.createDataFrame(
        [(i, page, [(*c, None) for c in given]) for i, (given, _) in enumerate(cases)],
        "i int, page string, cands array<struct<url:string,source:string,width:string,height:string>>",
    )
    got = rows.withColumn("m", select_lead_image("cands", "page")).orderBy("i").collect()
    assert [r.m and (r.m.url, r.m.width) for r in got] == [want for _, want in cases]
    html = spark.createDataFrame(
        [('<img src="/pixel.gif"><img src="s.gif?" data-src="/images/a">',), ('<img src="/x/y">',), ("none",)], "h string"
    )
    assert [r.f for r in html.select(first_image_in_html(F.col("h")).alias("f")).collect()] == ["/images/a", None, None]


def test_snippet(spark):
    row = spark.createDataFrame([("a \n  b" + "c" * 500,)], "t string").select(snippet(F.col("t")).alias("s")).first()
    assert row.s.startswith("a bc") and len(row.s) == 400
