"""Feed parsing: RSS, Atom and news sitemaps from a column of documents, with a status for each.

Input: any key columns and ``content``.  Spark's XML reader refuses entities that a document declares itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_space, strip_html, truncate
from ..functions.time import feed_date

_TEXT = "string"
RSS = "channel struct<item: array<struct<link: string, guid: struct<_VALUE: string, _isPermaLink: string>, title: string, description: string, author: string, `dc:creator`: string, pubDate: string, `dc:date`: string, category: array<string>, `content:encoded`: string>>>"
ATOM = "entry array<struct<link: array<struct<_rel: string, _href: string>>, title: string, summary: string, author: struct<name: string>, published: string, updated: string, id: string>>"
SITEMAP = "url array<struct<loc: string, lastmod: string, `news:news`: struct<`news:title`: string, `news:publication_date`: string, `news:keywords`: string>>>"
MAX_TITLE, MAX_SUBTITLE, MAX_BODY = 1000, 3000, 20_000


def kind_of(content: Column) -> Column:
    """rss, atom, sitemap, html, blocked or unknown."""
    head = F.lower(F.substring(F.ltrim(content), 1, 2000))
    return (
        F.when(content.isNull() | (F.trim(content) == ""), "unknown")
        .when(head.rlike(r"captcha|access denied|attention required|cf-browser-verification"), "blocked")
        .when(head.rlike(r"<!entity|<!doctype\s+[a-z]+\s*\["), "unsafe")
        .when(head.rlike(r"<rss[\s>]|<rdf:rdf"), "rss")
        .when(head.rlike(r"<feed[\s>]"), "atom")
        .when(head.rlike(r"<urlset[\s>]"), "sitemap")
        .when(head.rlike(r"<!doctype html|<html[\s>]"), "html")
        .otherwise("unknown")
    )


def _text(c: Column) -> Column:
    out = clean_space(F.coalesce(c, F.lit("")))
    return F.when(out != "", out)


def _plain(c: Column, limit: int) -> Column:
    return truncate(F.when(strip_html(c) != "", strip_html(c)), limit)


def _item(url, title, subtitle=None, author=None, published=None, modified=None, section=None, keywords=None, guid=None, body=None) -> Column:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c
    return F.struct(
        url.alias("url"), _plain(title, MAX_TITLE).alias("title"), (none if subtitle is None else _plain(subtitle, MAX_SUBTITLE)).alias("subtitle"), pick(author).alias("author"), pick(published).alias("published_raw"), pick(modified).alias("modified_raw"),
        pick(section).alias("section"), (F.array().cast("array<string>") if keywords is None else keywords).alias("keywords"), pick(guid).alias("guid"), (none if body is None else _plain(body, MAX_BODY)).alias("body"),
    )


def parse(docs: DataFrame, max_items: int = 200) -> DataFrame:
    """The key columns, status and one row an item: url, title, subtitle, author, published_raw, modified_raw, section,
    keywords, guid, body, and published (at, day, precision).  A document that is no feed has one row without item."""
    keys = [c for c in docs.columns if c != "content"]
    none = F.array().cast("array<string>")
    d = docs.withColumn("status", kind_of(F.col("content")))
    xml = lambda kind, schema: F.from_xml(F.when(F.col("status") == kind, F.col("content")), schema, {"mode": "PERMISSIVE", "ignoreNamespace": "false"})
    rss = F.transform(
        xml("rss", RSS)["channel"]["item"],
        lambda i: _item(
            F.coalesce(_text(i["link"]), F.when(F.coalesce(i["guid"]["_isPermaLink"], F.lit("true")) == "true", _text(i["guid"]["_VALUE"]))), i["title"], i["description"], F.coalesce(_text(i["dc:creator"]), _text(i["author"])), F.coalesce(_text(i["pubDate"]), _text(i["dc:date"])), None,
            F.get(i["category"], 0), F.coalesce(i["category"], none), _text(i["guid"]["_VALUE"]), i["content:encoded"],
        ),
    )
    link = lambda e: F.get(F.filter(e["link"], lambda k: (F.coalesce(k["_rel"], F.lit("alternate")) == "alternate") & k["_href"].isNotNull()), 0)["_href"]
    atom = F.transform(xml("atom", ATOM)["entry"], lambda e: _item(link(e), e["title"], e["summary"], _text(e["author"]["name"]), _text(e["published"]), _text(e["updated"]), None, None, _text(e["id"])))
    words = lambda k: F.filter(F.transform(F.split(F.coalesce(k, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    site = F.transform(xml("sitemap", SITEMAP)["url"], lambda u: _item(_text(u["loc"]), u["news:news"]["news:title"], None, None, _text(u["news:news"]["news:publication_date"]), _text(u["lastmod"]), None, words(u["news:news"]["news:keywords"])))
    items = F.slice(F.filter(F.coalesce(F.when(F.col("status") == "rss", rss).when(F.col("status") == "atom", atom).when(F.col("status") == "sitemap", site), F.array().cast(_ITEMS)), lambda i: i["url"].isNotNull() & i["title"].isNotNull()), 1, max_items)
    rows = d.select(*keys, "status", F.explode_outer(items).alias("item")).select(*keys, "status", "item.*")
    return rows.withColumn("published", feed_date(F.col("published_raw")))


_ITEMS = "array<struct<url: string, title: string, subtitle: string, author: string, published_raw: string, modified_raw: string, section: string, keywords: array<string>, guid: string, body: string>>"
