"""The engine's input tables, derived row by row from the benchmark tables.

Every binding is a projection (or a bounded regrouping) of a whole benchmark table, so its size
grows with that table. Values come from ids by arithmetic, which an oracle can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.operators.merge import resolve_open_errors
from storyledger.sizing import broadcast_if_small

ASOF_TEXT = "2024-01-31 00:00:00"
DOCS_PER_BATCH = 100


def asof() -> Column:
    return F.lit(ASOF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST({index} AS INT) + 1)"


SOURCE_TYPE_CYCLE = [
    "regulator", "exchange", "industry_body", "outlet", "wire", "analyst_blog",
    "company_blog", "code_release", "community",
]
FETCH_TYPE_CYCLE = ["rss", "atom", "scrape", "hn", "github_api"]
AUDIT_CYCLE = ["index_diff", "calendar_expect", "proxy_sample", "none"]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per distinct ``documents.source``."""
    sources = (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .withColumn("n", F.expr("CAST(substr(source, 4) AS INT)"))
    )
    return sources.select(
        F.col("source").alias("source_id"),
        F.col("source").alias("slug"),
        F.expr("concat('Source ', lpad(CAST(n AS STRING), 4, '0'))").alias("name"),
        F.expr("CASE WHEN n < 12 THEN 'finance' ELSE 'tech' END").alias("vertical"),
        F.expr("CASE WHEN n = 18 THEN 'data' ELSE 'news' END").alias("source_kind"),
        F.expr(_pick(SOURCE_TYPE_CYCLE, "n % 9")).alias("source_type"),
        F.expr("CASE WHEN n % 9 = 8 OR n % 10 = 9 THEN 'discovery' ELSE 'record' END").alias("source_role"),
        F.expr("concat('https://www.src', n, '.example.com/feed')").alias("feed_url"),
        F.expr(f"CASE WHEN n = 18 THEN 'json_api' ELSE {_pick(FETCH_TYPE_CYCLE, 'n % 5')} END").alias("fetch_type"),
        F.lit(None).cast("string").alias("user_agent"),
        F.expr("CASE WHEN n % 2 = 0 THEN concat('https://www.src', n, '.example.com/index') END").alias("index_url"),
        F.expr("CASE WHEN n % 6 <> 5 THEN '/A/[0-9]+' END").alias("index_link_pattern"),
        F.expr("n % 7 = 0").alias("lowercase_url_path"),
        F.expr(_pick(AUDIT_CYCLE, "n % 4")).alias("audit_strategy"),
        F.expr("CASE WHEN n = 13 THEN 'Mars/Olympus' WHEN n % 2 = 0 THEN 'Asia/Kolkata' ELSE 'America/New_York' END").alias("active_hours_tz"),
        F.expr("CASE n % 3 WHEN 0 THEN 9 WHEN 1 THEN 22 ELSE 0 END").alias("active_start_hour"),
        F.expr("CASE n % 3 WHEN 0 THEN 19 WHEN 1 THEN 6 ELSE 0 END").alias("active_end_hour"),
        F.expr("5 + 5 * (n % 4)").alias("active_interval_min"),
        F.expr("60 + 60 * (n % 3)").alias("off_interval_min"),
        F.timestamp_micros(F.unix_micros(asof()) + F.expr("(n - 10L) * 3600000000L")).alias("next_fetch_at"),
        F.when(F.col("n") != 16, F.timestamp_micros(F.unix_micros(asof()) - F.expr("n * 420000000L"))).alias("last_fetched_at"),
        F.expr("concat('etag-', n)").alias("last_etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.expr("10 + n").alias("feed_window_size"),
        F.expr("CAST(0.5 + (n % 5) / 8.0 AS FLOAT)").alias("reliability_weight"),
        F.expr("n % 2 = 1").alias("is_full_text"),
        F.expr("n <> 17").alias("is_active"),
        F.expr("array(concat('topic', n % 3), 'all')").alias("topics"),
        F.expr("CASE WHEN n % 8 = 3 THEN 'NEEDS SECTION FEEDS: site-wide for now' END").alias("notes"),
        F.lit("2023-12-01").cast("timestamp").alias("created_at"),
        F.lit("2023-12-01").cast("timestamp").alias("updated_at"),
    )


def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select(
        "source_id", "vertical", "source_type", "source_role", "lowercase_url_path"
    )


TEXT = """
CASE doc_id % 8
  WHEN 0 THEN concat('NEW DELHI (PTI) - ', text)
  WHEN 1 THEN concat('By Reuters - ', text)
  WHEN 2 THEN concat('People familiar with the matter said so. ', text)
  WHEN 3 THEN concat(text, ' Reuters reported')
  ELSE text END
"""
PUBLISHED_RAW = """
CASE doc_id % 6
  WHEN 0 THEN concat(date_format(fetched_at + INTERVAL '2:30' HOUR TO MINUTE, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0530')
  WHEN 1 THEN date_format(fetched_at - INTERVAL 1 HOUR, "yyyy-MM-dd'T'HH:mm:ss'Z'")
  WHEN 2 THEN date_format(fetched_at - INTERVAL 2 HOUR, 'yyyy-MM-dd HH:mm:ss')
  WHEN 3 THEN NULL
  WHEN 4 THEN date_format(fetched_at + INTERVAL 10 HOUR, "yyyy-MM-dd'T'HH:mm:ss'Z'")
  ELSE date_format(fetched_at - INTERVAL 200 DAY, "yyyy-MM-dd'T'HH:mm:ss'Z'") END
"""


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored article per document. The publication time and the wire come from jobs."""
    n = "CAST(substr(source, 4) AS INT)"
    docs = table(spark, sf_dir, "documents").withColumn("n", F.expr(n))
    docs = docs.withColumn(
        "fetched_at", F.timestamp_micros(F.unix_micros(asof()) - F.expr("(doc_id % 240) * 3600000000L"))
    )
    return docs.select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.expr("CASE WHEN n < 12 THEN 'finance' ELSE 'tech' END").alias("vertical"),
        F.expr("concat('https://src', n, '.example.com/A/', doc_id)").alias("url"),
        F.expr("concat('https://www.src', n, '.example.com/A/', doc_id, '/?utm_source=feed')").alias("url_raw"),
        F.expr("concat('Article number ', doc_id, ' of source ', n)").alias("title"),
        F.expr(TEXT).alias("text_content"),
        F.expr("concat('<p>', doc_id, '</p>')").alias("html_snapshot"),
        "fetched_at",
        F.expr(PUBLISHED_RAW).alias("published_at_raw"),
        F.expr(_pick(["pending", "ok", "partial", "failed", "skipped"], "doc_id % 5")).alias("extraction_status"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN array('src0.example.com', 'src1.example.com') ELSE CAST(array() AS ARRAY<STRING>) END").alias("origin_primary_links"),
        F.expr("CASE doc_id % 8 WHEN 0 THEN 'PTI' WHEN 1 THEN 'Reuters' WHEN 3 THEN 'Reuters' END").alias("origin_wire_byline"),
        F.expr("CASE doc_id % 8 WHEN 0 THEN 'dateline' WHEN 1 THEN 'byline' WHEN 3 THEN 'mention' END").alias("origin_wire_evidence"),
        F.expr(
            "CASE WHEN n % 9 = 8 OR n % 10 = 9 OR (n % 4 = 2 AND n <> 14) THEN"
            " concat('https://www.src', (n + 1) % 20, '.example.com/A/',"
            " doc_id + CASE WHEN doc_id % 3 = 0 THEN 1000000000 ELSE 1 END, '?utm_source=hn') END"
        ).alias("origin_discovery_target_url"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN concat('https://img.example.com/', doc_id, '.jpg') END").alias("image_url"),
        F.expr(f"CASE WHEN doc_id % 3 <> 0 THEN {_pick(['media_content', 'media_thumbnail', 'enclosure', 'content_img', 'og', 'twitter', 'inline'], 'doc_id % 7')} END").alias("image_source"),
        F.expr("CAST(CASE WHEN doc_id % 3 <> 0 THEN 200 + doc_id % 1000 END AS INT)").alias("image_width"),
        F.expr("CONCAT('story-', doc_id % 97)").alias("story_key"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per event."""
    events = table(spark, sf_dir, "events")
    items = "CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(floor(value) AS INT) % 40 END"
    return events.select(
        "event_id",
        F.expr("concat('src', user_id % 20)").alias("source_id"),
        F.col("ts").cast("timestamp").alias("attempted_at"),
        F.expr(
            "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 404 END"
            " WHEN event_type = 'view' THEN 304 ELSE 200 END"
        ).alias("http_status"),
        F.expr(items).alias("items_seen"),
        F.expr(f"({items}) % 31").alias("items_new"),
        F.expr(f"(({items}) % 31) DIV 2").alias("items_with_image"),
        F.expr("CAST(event_id % 1000 AS INT)").alias("duration_ms"),
        F.expr("CASE WHEN event_type = 'error' THEN 'http' END").alias("error"),
        F.expr("concat('host', user_id % 20, '.example.com')").alias("host"),
    )


def open_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows as they are written: open."""
    log = fetch_log(spark, sf_dir).filter(F.col("error").isNotNull())
    return log.select(
        "source_id",
        F.col("error").alias("error_type"),
        F.concat(F.lit("attempt "), F.col("event_id").cast("string")).alias("message"),
        F.col("attempted_at").alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows with the ones closed that a later success closes."""
    return resolve_open_errors(open_errors(spark, sf_dir), fetch_log(spark, sf_dir))


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an entry of its host's index; those that came over https are held."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.col("url").alias("url_raw"), F.col("page_id").alias("pos"),
        F.expr("url LIKE 'https://%'").alias("is_held"),
        F.expr("date_add(DATE'2024-01-01', CAST(page_id % 14 AS INT))").alias("audit_date"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the links of their navigation moved onto hosts of the registry, in turn."""
    pages = table(spark, sf_dir, "pages")
    anchors = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    links = F.transform(
        anchors,
        lambda h, i: F.concat(
            F.lit("https://www.src"), ((F.col("page_id") + i) % 20).cast("string"), F.lit(".example.com"), h
        ),
    )
    return pages.select("page_id", F.expr("concat('src', page_id % 20, '.example.com')").alias("page_host"), links.alias("hrefs"))


def pull_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as four items of a pull: as it is, tracked, as its AMP page, without a scheme.

    A fifth item per page is a script link, which must drop out.
    """
    pages = table(spark, sf_dir, "pages")
    variants = F.array(
        F.col("url"),
        F.expr(
            "CASE WHEN contains(url, '#') THEN regexp_replace(url, '#', concat(CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_medium=x#'))"
            " ELSE concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_medium=x') END"
        ),
        F.expr("concat(rtrim('/', regexp_extract(url, '^[^?#]*', 0)), '/amp', regexp_extract(url, '^[^?#]*(.*)$', 1))"),
        F.expr("regexp_replace(url, '^https?:', '')"),
        F.lit("javascript:void(0)"),
    )
    return pages.select(
        F.expr("concat('pull-', page_id % 5)").alias("pull_id"),
        "page_id",
        F.posexplode(variants).alias("k", "url_raw"),
    ).withColumn("pos", F.col("page_id") * 5 + F.col("k"))


# ---- payloads ------------------------------------------------------------------------


def _escape(col: str) -> str:
    return f"replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def payload_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the pulls that carry them: a few per source and batch of ids."""
    docs = raw_documents(spark, sf_dir)
    # A shuffle join would deal the documents by source, and their pulls would stay dealt so: a task for a whole source.
    facts = broadcast_if_small(registry(spark, sf_dir).select("source_id", "fetch_type"))
    return (
        docs.join(facts, "source_id")
        .withColumn("batch", F.expr(f"doc_id DIV {DOCS_PER_BATCH}"))
        .withColumn("pull_id", F.expr("concat(source_id, '-', batch)"))
    )


ITEM_XML = f"""
concat('<item><title>', title, '</title><link>', url_raw, '</link><guid isPermaLink="false">', doc_id, '</guid>',
  CASE WHEN published_at_raw IS NULL THEN '' ELSE concat('<pubDate>', published_at_raw, '</pubDate>') END,
  '<dc:creator>Desk ', doc_id % 3, '</dc:creator>',
  CASE WHEN doc_id % 3 = 1 THEN concat('<media:content url="/img/', doc_id, '.jpg#x" width="640" medium="image"/><media:content url="https://img.example.com/', doc_id, '-big.jpg" width="1200px" type="image/jpeg"/><media:content url="https://img.example.com/v.mp4" type="video/mp4" width="4000"/>') ELSE '' END,
  CASE WHEN doc_id % 3 = 2 THEN concat('<enclosure url="https://img.example.com/1x1/', doc_id, '.png" type="image/png"/><content:encoded>&lt;p&gt;&lt;img src="https://img.example.com/media/', doc_id, '.webp"&gt;&lt;/p&gt;</content:encoded>') ELSE '' END,
  '<description>', {_escape("text_content")}, '</description></item>')
"""
ENTRY_XML = f"""
concat('<entry><title type="html">', title, '</title><link href="', replace(url_raw, '&', '&amp;'), '" rel="alternate"/><id>', doc_id, '</id>',
  CASE WHEN published_at_raw IS NULL THEN '' ELSE concat('<updated>', published_at_raw, '</updated>') END,
  '<author><name>Desk ', doc_id % 3, '</name></author><content type="text">', {_escape("text_content")}, '</content></entry>')
"""
ANCHOR_HTML = "concat('<li><a href=\"/A/', doc_id, '\">', title, ' with a full headline</a></li>')"
STORY_JSON = (
    "to_json(named_struct('objectID', CAST(doc_id AS STRING), 'title', concat(' ', title, ' '), 'url',"
    " CASE WHEN doc_id % 4 <> 0 THEN url_raw END, 'author', concat('user', doc_id % 7), 'created_at', published_at_raw,"
    " 'story_text', CASE WHEN doc_id % 2 = 0 THEN text_content END))"
)
RELEASE_JSON = (
    "to_json(named_struct('html_url', CASE WHEN doc_id % 11 <> 10 THEN url END, 'name', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE title END,"
    " 'tag_name', CASE WHEN doc_id % 2 = 0 THEN concat('v', doc_id) END, 'published_at', published_at_raw, 'body', text_content,"
    " 'draft', doc_id % 7 = 3, 'author', named_struct('login', concat('dev', doc_id % 7))))"
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed payloads: a feed, index page, story list or release list per pull.

    A batch holds a fixed number of ids, so a payload stays small at any scale. Some batches
    are broken on purpose: HTML in place of the payload, blank, 503, 304, no response, wrong shape.
    """
    part = F.expr(
        f"CASE fetch_type WHEN 'rss' THEN {ITEM_XML} WHEN 'atom' THEN {ENTRY_XML} WHEN 'scrape' THEN {ANCHOR_HTML}"
        f" WHEN 'hn' THEN {STORY_JSON} WHEN 'github_api' THEN {RELEASE_JSON} ELSE '' END"
    )
    pulls = (
        payload_docs(spark, sf_dir)
        .select("pull_id", "source_id", "fetch_type", "batch", "doc_id", "fetched_at", part.alias("piece"))
        .groupBy("pull_id", "source_id", "fetch_type", "batch")
        .agg(
            F.array_sort(F.collect_list(F.struct("doc_id", "piece"))).alias("pieces"),
            F.max("fetched_at").alias("fetched_at"),
        )
    )
    n = "CAST(substr(source_id, 4) AS INT)"
    body = (
        "CASE fetch_type"
        " WHEN 'rss' THEN concat('<?xml version=\"1.0\"?><rss version=\"2.0\" xmlns:media=\"http://search.yahoo.com/mrss/\" xmlns:dc=\"http://purl.org/dc/elements/1.1/\" xmlns:content=\"http://purl.org/rss/1.0/modules/content/\"><channel><title>Feed</title>', array_join(pieces.piece, ''), '</channel></rss>')"
        " WHEN 'atom' THEN concat('<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>Feed</title><id>x</id><updated>2024-01-01T00:00:00Z</updated>', array_join(pieces.piece, ''), '</feed>')"
        " WHEN 'scrape' THEN concat('<html><body><nav><a href=\"/about/team\">About the whole team of this site</a></nav><ul>', array_join(pieces.piece, ''), '</ul></body></html>')"
        " WHEN 'hn' THEN concat('{\"hits\":[', array_join(pieces.piece, ','), ']}')"
        " ELSE concat('[', array_join(pieces.piece, ','), ']') END"
    )
    return pulls.withColumn("slot", F.expr(f"(batch + {n}) % 9")).select(
        "pull_id",
        "source_id",
        F.when(F.col("fetch_type") == "github_api", F.concat(F.lit("org/repo-"), F.col("source_id"))).alias("part"),
        F.lit(0).alias("part_no"),
        "fetch_type",
        F.expr("CASE slot WHEN 3 THEN 503 WHEN 4 THEN 304 WHEN 8 THEN NULL ELSE 200 END").alias("http_status"),
        F.expr(
            "CASE WHEN slot IN (3, 4, 8) THEN '' WHEN slot = 5 THEN '  \n ' WHEN slot = 6 THEN '<html><body>moved</body></html>'"
            f" WHEN slot = 7 AND fetch_type IN ('hn', 'github_api') THEN '{{\"message\":\"slow down\"}}' ELSE {body} END"
        ).alias("body"),
        F.expr("concat('etag-', pull_id)").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        "fetched_at",
    )


def index_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages of every source: its articles, plus unheld ones for documents in French."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_id"), "doc_id", "lang",
        F.expr("concat(source, '-', doc_id DIV 100)").alias("pull_id"),
    )
    anchor = F.expr(
        "concat('<a href=\"/A/', doc_id, '?utm_source=index\">Article number ', doc_id, ' with a full headline</a>',"
        " CASE WHEN lang = 'fr' THEN concat('<a href=\"/A/', doc_id + 5000000000, '\">Article en français numéro ', doc_id, '</a>') ELSE '' END)"
    )
    return (
        docs.withColumn("piece", anchor)
        .groupBy("pull_id", "source_id")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece"))).alias("pieces"))
        .select(
            "pull_id",
            "source_id",
            F.expr("concat('<html><body>', array_join(pieces.piece, ' '), '</body></html>')").alias("body"),
        )
    )


# ---- pages and images ----------------------------------------------------------------


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a byline, a quotation, an image and sharing metadata put into their markup."""
    pages = table(spark, sf_dir, "pages")
    extra = F.expr(
        "concat('<article><div class=\"byline\">', CASE page_id % 4 WHEN 0 THEN 'By Reuters' WHEN 1 THEN 'Press Trust of India' WHEN 2 THEN 'A. Writer' ELSE 'AP' END, '</div>',"
        " CASE WHEN page_id % 3 = 0 THEN concat('<blockquote>', repeat('quoted words ', 20), '</blockquote>') ELSE '<blockquote>short</blockquote>' END,"
        " CASE WHEN page_id % 2 = 0 THEN concat('<img src=\"/pixel.gif\"><img data-src=\"/images/', page_id, '.jpg\" width=\"800\" height=\"450\">') ELSE '' END)"
    )
    meta = F.expr(
        "CASE WHEN page_id % 5 = 0 THEN concat('<head><meta property=\"og:image\" content=\"//cdn.example.com/', page_id, '.png\">') ELSE '<head>' END"
    )
    html = F.expr("html")
    html = F.replace(html, F.lit("<article>"), extra)
    html = F.replace(html, F.lit("<head>"), meta)
    return pages.select("page_id", "url", html.alias("html"))


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a list of lead-image candidates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")

    def one(url: str, source: str, width: str = "NULL", height: str = "NULL") -> str:
        return (
            f"named_struct('url', {url}, 'source', '{source}',"
            f" 'width', CAST({width} AS STRING), 'height', CAST({height} AS STRING))"
        )

    cases = [
        f"array({one("concat('https://img.example.com/', doc_id, '-s.jpg')", 'media_content', "'320'")}, {one("concat('https://img.example.com/', doc_id, '-l.jpg')", 'media_content', "'1200px'")}, {one("'https://img.example.com/huge.jpg'", 'og', "'4000'")})",
        f"array({one("'https://img.example.com/pixel.gif'", 'media_content')}, {one("concat('/media/', doc_id, '.png')", 'og')})",
        f"array({one("concat('//cdn.example.com/', doc_id, '.webp#frag')", 'media_thumbnail', "'199'")}, {one("concat('../up/', doc_id, '.webp')", 'enclosure')})",
        f"array({one("'data:image/png;base64,xyz'", 'content_img')}, {one("'Photo unavailable'", 'content_img')})",
        f"array({one("concat('rel/', doc_id, '.jpg')", 'inline', "'640.5'", "'2'")}, {one("concat('rel/', doc_id, '-b.jpg')", 'inline', "'640.5'", "'auto'")}, {one("concat('rel/', doc_id, '-c.jpg')", 'inline', "'641'")})",
    ]
    chosen = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    chosen += " ELSE CAST(array() AS ARRAY<STRUCT<url:STRING,source:STRING,width:STRING,height:STRING>>) END"
    return docs.select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.expr("concat('https://', source, '.example.com/A/', doc_id)").alias("page_url"),
        F.expr(chosen).alias("candidates"),
    )


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article page per document: most in order, some failed, some missing from the archive."""
    docs = raw_documents(spark, sf_dir)
    body = F.expr(
        "concat('<html><head><title>', title, ' | Site</title><meta property=\"og:image\" content=\"/og/', doc_id, '.jpg\"></head><body>',"
        " '<nav><a href=\"/home\">Home</a></nav><article><span class=\"author\">Desk ', doc_id % 3, '</span><p>',"
        f" {_escape('text_content')}, '</p><a href=\"https://www.src', (doc_id + 1) % 20, '.example.com/circular\">release</a></article></body></html>')"
    )
    return docs.select(
        "url",
        F.expr("CASE doc_id % 10 WHEN 7 THEN 404 WHEN 8 THEN NULL ELSE 200 END").alias("page_status"),
        F.when(F.expr("doc_id % 10 = 9"), F.lit(" ")).otherwise(body).alias("page_body"),
    )
