"""Feeds, pages and streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumewire.operators import metrics
from plumewire.sources import feeds, pages
from plumewire.streaming import stream

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>x</title>
<item><title><![CDATA[Sube el <b>gas</b>]]></title><link>https://a/1</link><guid isPermaLink="false">g1</guid><pubDate>Tue, 06 Oct 2026 15:00:00 GMT</pubDate><dc:creator>Ana</dc:creator><category>eco</category><description>Una &amp; otra</description></item>
<item><title>Sin enlace</title></item><item><title>Con guid</title><guid>https://a/2</guid><pubDate>2026-10-06</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Nota</title><link rel="self" href="https://s"/><link rel="alternate" href="https://b/1"/><published>2026-10-06T12:00:00-03:00</published><id>i</id></entry></feed>"""
SITE = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>https://c/1</loc><news:news><news:title>Título</news:title><news:publication_date>2026-10-06</news:publication_date><news:keywords>a, b,</news:keywords></news:news></url><url><loc>https://c/2</loc></url></urlset>"""


def test_feeds(spark):
    docs = [(1, RSS), (2, ATOM), (3, SITE), (4, "<!DOCTYPE html><html></html>"), (5, None), (6, '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><rss></rss>'), (7, "<html>captcha</html>")]
    got = feeds.parse(spark.createDataFrame(docs, "id long, content string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [(r.url, r.title, r.author, r.published.precision) for r in sorted(by[1], key=lambda r: r.url)] == [("https://a/1", "Sube el gas", "Ana", "datetime"), ("https://a/2", "Con guid", None, "date")]
    assert by[1][0].keywords == ["eco"] and by[1][0].subtitle == "Una & otra"
    assert [(r.url, str(r.published.at)) for r in by[2]] == [("https://b/1", "2026-10-06 15:00:00")]
    assert [(r.url, r.keywords) for r in by[3]] == [("https://c/1", ["a", "b"])]
    assert {i: by[i][0].status for i in (4, 5, 6, 7)} == {4: "html", 5: "unknown", 6: "unsafe", 7: "blocked"}


PAGE = """<html><head><title>T</title><link rel="canonical" href="https://a/canon"><meta property="og:title" content="Título &quot;x&quot;"><meta content="Desc" name="description"><meta property="article:published_time" content="2026-10-06">
<script type="application/ld+json">{"@type": "NewsArticle", "author": {"name": "Ana"}, "articleSection": "Eco"}</script></head><body><header><a href="/no">cabecera</a></header><article><p>x <a href="https://other.com/n?utm_source=z">otra nota</a></p></article></body></html>"""


def test_page_metadata(spark):
    p = spark.createDataFrame([(1, "https://www.a.com/n", PAGE), (2, "u", None)], "page_id long, url string, html string")
    r = pages.metadata(p).where("page_id = 1").first()
    assert (r.canonical, r.title, r.description, r.authors, r.section, r.published_raw) == ("https://a/canon", 'Título "x"', "Desc", ["Ana"], "Eco", "2026-10-06")
    assert {(x.url, x.in_article) for x in r.links} == {("/no", False), ("https://other.com/n?utm_source=z", True)}
    hosts = spark.createDataFrame([("other.com", 5), ("a.com", 1)], "host string, media_id long")
    assert [tuple(x) for x in pages.references(p, hosts).collect()] == [(1, "other.com", 5, "https://other.com/n")]


def test_section_links(spark):
    heads = '<h2><a href="https://a/1">Un titular bastante largo</a></h2><a href="https://a/1">Leer</a><a href="https://a/9">Un texto cualquiera largo</a>'
    flat = '<a href="https://a/1">Un texto cualquiera</a><a href="https://a/1">Un texto cualquiera más largo</a><a href="https://a/2">corto</a>'
    got = pages.section_links(spark.createDataFrame([(1, heads), (2, flat)], "page_id long, html string"))
    assert sorted((r.page_id, r.url, r.text) for r in got.collect()) == [(1, "https://a/1", "Un titular bastante largo"), (2, "https://a/1", "Un texto cualquiera más largo")]


def test_imported_posts(spark):
    raw = ['{"id_str": "7", "full_text": "RT @x hola", "user": {"screen_name": "Ana"}, "created_at": "Tue Oct 06 15:00:00 +0000 2026"}', '{"id": "8", "text": "hola", "username": "b", "date": "2026-10-06T15:00:00Z"}', '{"text": "sin id"}']
    df = spark.createDataFrame([(x,) for x in raw], "j string").select(F.try_parse_json("j").alias("v"))
    got = sorted((r.external_id, r.handle, str(r.posted_at), r.is_repost) for r in pages.imported_posts(df).collect())
    assert got == [("7", "ana", "2026-10-06 15:00:00", True), ("8", "b", "2026-10-06 15:00:00", False)]


def test_windows_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    s = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    q = stream.windowed_counts(s, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.windowed_counts(events, "ts", "event_type")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_versions_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    data = [(1, "feed", "h1", "a", datetime(2026, 1, 1)), (1, "feed", "h1", "a", datetime(2026, 1, 2)), (1, "feed", "h2", "b", datetime(2026, 1, 3)), (1, "site", "h1", "a", datetime(2026, 1, 1))]
    schema = "article_id long, subsource_id string, hash string, title string, at timestamp"
    spark.createDataFrame(data[:2], schema).coalesce(1).write.mode("append").parquet(str(source))
    spark.createDataFrame(data[2:], schema).coalesce(1).write.mode("append").parquet(str(source))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = stream.headline_versions(s).writeStream.format("memory").queryName("v").outputMode("append").option("checkpointLocation", str(tmp_path / "v")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.subsource_id, r.version, r.title) for r in spark.table("v").collect()) == [("feed", 1, "a"), ("feed", 2, "b"), ("site", 1, "a")]


def test_merge_by_batches(spark, tmp_path):
    runs = spark.createDataFrame([(i, datetime(2026, 1, 1) + timedelta(hours=i), "feed", 1, "ok", 1) for i in range(6)], "id long, started_at timestamp_ntz, run_type string, scope long, status string, items long")
    fold = stream.merged_into(str(tmp_path / "t"), lambda old, new: metrics.daily_rollup(new) if old is None else metrics.extend_rollup(old, new))
    fold(runs.where("id < 3"), 0)
    fold(runs, 1)
    fold(runs, 1)
    assert [(r.runs, r.last_run_id) for r in spark.read.parquet(str(tmp_path / "t" / "v=1")).collect()] == [(6, 5)]


def test_raw_titles(spark):
    """References other than that of & stay, a title without an end is none, and a null page has no title."""
    cases = [(1, "<TITLE a=1> A &quot;b&quot;\n &amp; c </title><title>x</title>"), (2, "<title>never"), (3, None), (4, "<p>"), (5, "<title>" * 20000)]
    got = {r.page_id: r.title for r in pages.raw_titles(spark.createDataFrame([(i, "u", h) for i, h in cases], "page_id long, url string, html string")).collect()}
    assert got == {1: "A &quot;b&quot; & c", 2: "", 3: None, 4: "", 5: ""}
