from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyledger.functions.urls import is_same_domain, with_budget_host, with_canonical_url, with_resolved

CASES = [
    # Four ways to the same article.
    ("https://www.daily.example.com/news/a-story/?utm_source=rss&fbclid=1", "https://daily.example.com/news/a-story"),
    ("https://amp.daily.example.com/news/a-story", "https://daily.example.com/news/a-story"),
    ("https://daily.example.com/news/a-story/amp/", "https://daily.example.com/news/a-story"),
    ("https://daily-example-com.cdn.ampproject.org/c/s/www.daily.example.com/news/a-story?x=1", "https://daily.example.com/news/a-story?x=1"),
    ("http://daily-example-com.cdn.ampproject.org/c/daily.example.com/a", "http://daily.example.com/a"),
    # Order of parameters, stable by key.
    ("https://x.example.com/?b=2&a=1&b=1", "https://x.example.com/?a=1&b=2&b=1"),
    ("https://x.example.com/p?flag&q=a%20b", "https://x.example.com/p?flag=&q=a+b"),
    ("https://x.example.com/p?q=50%&z=%C3%A9", "https://x.example.com/p?q=50%25&z=%C3%A9"),
    # Mixed-case names are looked up in lower case, so they stay.
    ("https://x.example.com/p?outputType=amp&UTM_Medium=y", "https://x.example.com/p?outputType=amp"),
    ("HTTPS://X.Example.COM:443/Path#frag", "https://x.example.com/Path"),
    ("http://x.example.com:80/", "http://x.example.com/"),
    ("http://x.example.com:8080/a//b/", "http://x.example.com:8080/a/b"),
    ("https://x.example.com/company/amp-energy", "https://x.example.com/company/amp-energy"),
    ("https://x.example.com/amp/story", "https://x.example.com/story"),
    ("https://x.example.com/a/./b/../c", "https://x.example.com/a/c"),
    ("https://x.example.com/é a", "https://x.example.com/%C3%A9%20a"),
    ("https://m.co/x", "https://m.co/x"),
    ("https://www.m.x.com/", "https://m.x.com/"),
    ("//cdn.example.com/x", "https://cdn.example.com/x"),
    ("bare.example.com/x", "https://bare.example.com/x"),
    ("host:8080/x", None),
    ("javascript:alert(1)", None),
    ("mailto:a@example.com", None),
    ("https://", None),
    ("   ", None),
    (" https://x.example.com/t ", "https://x.example.com/t"),
    (None, None),
]


def canonical(spark, urls, **options):
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    done = with_canonical_url(rows, "u", out="c", **options).orderBy("i").collect()
    return [r.c for r in done]


def test_canonical_forms(spark):
    got = canonical(spark, [c[0] for c in CASES])
    assert dict(zip([c[0] for c in CASES], got)) == dict(CASES)


def test_options(spark):
    assert canonical(spark, ["https://www.x.example.com/A?B=1"], keep_prefix=True) == ["https://www.x.example.com/A?B=1"]
    assert canonical(spark, ["https://x.example.com/A?B=C"], lowercase=F.lit(True)) == ["https://x.example.com/a?B=C"]
    assert canonical(spark, ["https://x.example.com/a?outputType=b"], strip_mixed_case=True) == ["https://x.example.com/a"]


part = st.text("abcXYZ019-_", min_size=1, max_size=6)
url = st.builds(
    lambda host, path, query: f"https://{host}.example.com/{'/'.join(path)}" + ("?" + "&".join(f"{k}={v}" for k, v in query) if query else ""),
    part.map(str.lower).map(lambda h: "h" + h.strip("-_")), st.lists(part, max_size=3), st.lists(st.tuples(part, part), max_size=3, unique_by=lambda p: p[0]),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(url, min_size=20, max_size=40))
def test_canonical_is_idempotent_and_ignores_noise(spark, urls):
    once = canonical(spark, urls)
    assert canonical(spark, once) == once
    noisy = [u + ("&" if "?" in u else "?") + "utm_campaign=z#f" for u in urls]
    assert canonical(spark, noisy) == once
    turned = [u.split("?")[0] + ("?" + "&".join(reversed(u.split("?")[1].split("&"))) if "?" in u else "") for u in urls]
    assert canonical(spark, turned) == once


def test_resolution(spark):
    base = "https://Site.example.com/a/b?q=1#z"
    cases = {
        "/c": "https://site.example.com/c",
        "c d": "https://site.example.com/a/c%20d",
        "../../c": "https://site.example.com/c",
        "?x": "https://site.example.com/a/b?x",
        "#k": "https://site.example.com/a/b?q=1#k",
        "//other.example.com": "https://other.example.com/",
        "ftp://x.example.com/": None,
        "tel:123": None,
    }
    rows = spark.createDataFrame([(h, base) for h in cases], "h string, b string")
    got = {r.h: r.resolved for r in with_resolved(rows, "h", "b").collect()}
    assert got == cases


def test_budget_host_and_domains(spark):
    rows = spark.createDataFrame([("https://www.M.x.com/a",), ("nonsense",)], "u string")
    assert {r.host for r in with_budget_host(rows, "u").collect()} == {"m.x.com", "unknown"}
    pairs = spark.createDataFrame(
        [("gov.example", "www.gov.example", True), ("docs.gov.example", "gov.example", True), ("notgov.example", "gov.example", False), ("gov.example.evil", "gov.example", False), (None, "gov.example", False)],
        "host string, domain string, want boolean",
    )
    assert all(r.got == r.want for r in pairs.select("want", is_same_domain(F.col("host"), F.col("domain")).alias("got")).collect())
