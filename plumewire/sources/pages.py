"""Article and section pages: metadata, links, post lists.  Patterns over the page text, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, clean_space, compact_count, strip_html
from ..operators.shared import kept


#: Fixed: the characters of windows-1252 at 0x80 to 0x9F, which pages mean when they say ISO-8859-1 too; five are free.
_WESTERN = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def _western(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, range(0x80, 0xA0))), _WESTERN)


def decode(body: Column, header: Column) -> Column:
    """Text of a page's bytes, by the charset of the header, or else of the page's own meta tag, or UTF-8."""
    ascii_ = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    name = F.lower(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(ascii_, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1), F.lit(""))))
    return F.when(name.isin("iso-8859-1", "latin1", "latin-1", "windows-1252"), _western(F.decode(body, "ISO-8859-1"))).otherwise(F.try_validate_utf8(F.decode(body, "UTF-8")))


#: Each of these goes on to the end of the page where its end is missing, as in a browser: no part is read twice.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>])[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)"
_SCRIPT = r"(?is)<script(?=[\s/>])[^>]*+(?:>.*?(?:</script|\z)|\z)"
_TITLE = r"(?is)<title(?=[\s/>])[^>]*+(?:>(.*?)(?:</title|\z)|\z)"
_ARTICLE = r"(?is)<(article|main)(?=[\s/>])[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)"
#: The first title as it stands: none where its end is missing.
_RAW_TITLE = r"(?is)<title[^>]*+(?:>(?:(.*?)</title|.*\z)|\z)"
#: A link goes on to its end or to the next link.
_ANCHOR = r"(?is)<a(?=[\s/>])[^>]*+(?:>.*?(?=</?a(?=[\s/>])|\z)|\z)"


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, with character references for & and quotes read."""
    raw = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 1)
    other = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 2)
    bare = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 3)
    value = F.concat(raw, other, bare)
    return F.when(value != "", F.replace(F.replace(value, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))


def metadata(pages: DataFrame) -> DataFrame:
    """page_id, url, canonical, title, description, site_name, published_raw, modified_raw, authors, section, keywords,
    has_paywall, links (url, text, in_article) of article pages.  What the page's own tags don't say comes from its
    JSON-LD articles, the first that says it (``ld_metadata``); their authors come after the page's."""
    tagged = page_tags(pages)
    held = tagged.join(ld_metadata(pages), "row", "left")
    none = F.array().cast("array<string>")
    either = lambda c: F.coalesce(c, f"ld_{c}").alias(c)
    return held.select(
        "page_id", "url", "canonical", "title", either("description"), "site_name", either("published_raw"), either("modified_raw"), F.array_distinct(F.concat("authors", F.coalesce("ld_authors", none))).alias("authors"), either("section"),
        F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.coalesce("ld_keywords", none)).alias("keywords"), (F.col("has_paywall") | F.coalesce("ld_paywall", F.lit(False))).alias("has_paywall"), "links",
    )


def raw_titles(pages: DataFrame) -> DataFrame:
    """page_id, title: the page's title tag as it was written, in one line, with references for & read and no others; empty
    where there is none, null for a page that is null."""
    written = F.replace(F.regexp_extract("html", _RAW_TITLE, 1), F.lit("&amp;"), F.lit("&"))
    return pages.select("page_id", F.trim(F.regexp_replace(written, r"[\t\n\f\r ]+", " ")).alias("title"))


def _row() -> Column:
    """Tells pages apart: two rows with one id and one text are the same page."""
    return F.xxhash64("page_id", "url", "html").alias("row")


def page_tags(pages: DataFrame) -> DataFrame:
    """What ``metadata`` has from the page's own tags alone, and ``row``."""
    html = F.coalesce("html", F.lit(""))
    tags = F.regexp_extract_all(visible(F.col("html")), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    named = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(_attribute(t, "property"), _attribute(t, "name"))).alias("n"), _attribute(t, "content").alias("v")))
    meta = F.aggregate(F.filter(named, lambda m: m["n"].isNotNull() & m["v"].isNotNull()), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, m: F.when(F.map_contains_key(acc, m["n"]), acc).otherwise(F.map_concat(acc, F.create_map(m["n"], m["v"]))))
    get = lambda *names: F.coalesce(*(F.nullif(clean_space(F.try_element_at(F.col("meta"), F.lit(n))), F.lit("")) for n in names))
    link = F.get(F.filter(F.regexp_extract_all(visible(F.col("html")), F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: F.lower(F.coalesce(_attribute(t, "rel"), F.lit(""))) == "canonical"), 0)
    shown = visible(F.col("html"))
    held = pages.select("page_id", "url", _row(), html.alias("html"), shown.alias("shown"), meta.alias("meta"), link.alias("canonical_tag"), F.regexp_extract(shown, _ARTICLE, 0).alias("article"))
    anchors = lambda c, inside: F.transform(F.regexp_extract_all(c, F.lit(_ANCHOR), F.lit(0)), lambda a: F.struct(_attribute(_opening(a), "href").alias("url"), _inner(a).alias("text"), F.lit(inside).alias("in_article")))
    whole = F.replace(F.col("shown"), F.col("article"), F.lit(" "))
    author = get("author", "article:author")
    return held.select(
        "row", "page_id", "url", F.coalesce(_attribute(F.col("canonical_tag"), "href"), get("og:url")).alias("canonical"), F.coalesce(get("og:title"), F.nullif(strip_html(F.regexp_extract("shown", _TITLE, 1)), F.lit(""))).alias("title"),
        get("og:description", "description").alias("description"), get("og:site_name").alias("site_name"), get("article:published_time", "datepublished").alias("published_raw"), get("article:modified_time", "datemodified").alias("modified_raw"),
        F.filter(F.array(F.when(~F.startswith(author, F.lit("http")), author)), lambda x: x.isNotNull()).alias("authors"), get("article:section").alias("section"),
        _listed(F.coalesce(get("news_keywords", "keywords"), F.lit(""))).alias("keywords"), F.col("html").rlike(r"(?i)paywall|isAccessibleForFree\"?\s*:\s*\"?false|suscriptores").alias("has_paywall"),
        F.filter(F.concat(anchors(F.col("article"), True), anchors(F.when(F.col("article") != "", whole).otherwise(F.col("shown")), False)), lambda x: x["url"].isNotNull()).alias("links"),
    )


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


#: Fixed: the types of JSON-LD objects that are articles.
LD_ARTICLES = ["newsarticle", "article", "reportagenewsarticle", "analysisnewsarticle", "opinionnewsarticle", "liveblogposting", "blogposting"]


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _elements(rows: DataFrame, *keep: str) -> DataFrame:
    """The elements of the arrays in column ``v``, with their places ``pos``."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*(rows[c] for c in keep), F.col("pos"), F.col("value").alias("v"))


def ld_objects(pages: DataFrame) -> DataFrame:
    """row, place, v: every object of every JSON-LD block of a page, in lists at any depth and under ``@graph``.  Places are
    arrays that put the objects in order: blocks in turn, an object before what its graph holds, the last of a list first.
    Blocks that are no JSON have none.  A round takes one level; the objects of a page are as many as its text has room for."""
    scripts = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?(?:-->|\z)", " "), F.lit(_SCRIPT), F.lit(0))
    found = F.filter(scripts, lambda x: F.regexp_extract(x, r"(?is)^<script[^>]*+", 0).rlike(r"(?i)application/ld\+json"))
    blocks = pages.select(_row(), F.posexplode(found).alias("block", "text")).distinct()
    body = F.regexp_extract("text", r"(?is)^<script[^>]*+>(.*?)(?:</script)?\z", 1)
    level = blocks.select("row", F.array("block").alias("place"), F.try_parse_json(body).alias("v")).where("v is not null")
    out = None
    while True:
        level = kept(level.select("*", _kind(F.col("v")).alias("kind")))
        if level.isEmpty():
            return out if out is not None else level.select("row", "place", "v")
        objects = level.where("kind = 'OBJECT'").select("row", "place", "v")
        out = objects if out is None else out.unionByName(objects)
        listed = _elements(level.where("kind = 'ARRAY'").select("row", "place", "v"), "row", "place").select("row", F.array_append("place", -F.col("pos")).alias("place"), "v")
        graphs = objects.select("row", F.array_append("place", F.lit(1)).alias("place"), F.try_variant_get("v", "$['@graph']", "variant").alias("v"))
        level = listed.unionByName(graphs).where("v is not null")


def _names(rows: DataFrame) -> DataFrame:
    """row, place, at, name: the names in column ``v``: a text, an object's name, or those of a list's elements at any depth."""
    out, level = None, rows.select("row", "place", F.array().cast("array<int>").alias("at"), "v").where("v is not null")
    while True:
        level = kept(level.select("*", _kind(F.col("v")).alias("kind")))
        if level.isEmpty():
            return out if out is not None else level.select("row", "place", "at", F.lit(None).cast("string").alias("name"))
        inner = F.try_variant_get("v", "$.name", "variant")
        name = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string")).when((F.col("kind") == "OBJECT") & (F.schema_of_variant(inner) == "STRING"), F.try_variant_get("v", "$.name", "string"))
        said = level.select("row", "place", "at", clean_space(name).alias("name")).where("name <> ''")
        out = said if out is None else out.unionByName(said)
        level = _elements(level.where("kind = 'ARRAY'").select("row", "place", "at", "v"), "row", "place", "at").select("row", "place", F.array_append("at", F.col("pos")).alias("at"), "v")


def ld_metadata(pages: DataFrame) -> DataFrame:
    """row, ld_published_raw, ld_modified_raw, ld_description, ld_section, ld_keywords, ld_authors, ld_paywall of the pages with a JSON-LD
    article: of each the first article that says it, of the authors all, of the paywall any."""
    kind = lambda path: F.try_variant_get("v", path, "variant")
    text = lambda key: F.when(F.schema_of_variant(kind(f"$.{key}")) == "STRING", F.nullif(F.try_variant_get("v", f"$.{key}", "string"), F.lit("")))
    types = F.when(F.schema_of_variant(kind("$['@type']")) == "STRING", F.array(F.try_variant_get("v", "$['@type']", "string"))).otherwise(F.try_variant_get("v", "$['@type']", "array<string>"))
    articles = kept(ld_objects(pages).where(F.arrays_overlap(F.transform(types, F.lower), F.array(*map(F.lit, LD_ARTICLES)))))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("place")))
    free = F.lower(F.try_variant_get("v", "$.isAccessibleForFree", "string"))
    words = F.when(F.size(_listed(text("keywords"))) > 0, _listed(text("keywords")))
    said = articles.groupBy("row").agg(
        first(text("datePublished")).alias("ld_published_raw"), first(text("dateModified")).alias("ld_modified_raw"), first(F.nullif(clean_space(text("description")), F.lit(""))).alias("ld_description"), first(words).alias("ld_keywords"), first(F.nullif(clean_space(text("articleSection")), F.lit(""))).alias("ld_section"), F.bool_or(F.coalesce(free == "false", F.lit(False))).alias("ld_paywall")
    )
    authors = _names(articles.select("row", "place", kind("$.author").alias("v")))
    named = authors.groupBy("row").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "name"))), lambda x: x["name"])).alias("ld_authors"))
    return said.join(named, "row", "left")


def _opening(anchor: Column) -> Column:
    return F.regexp_extract(anchor, r"(?s)^<[^>]*+>?", 0)


def _inner(anchor: Column) -> Column:
    return strip_html(F.regexp_replace(anchor, r"(?is)^<a\b[^>]*+>?|</a\s*+>$", ""))


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, text of every link: its text goes up to its end or to the next link."""
    found = F.regexp_extract_all(visible(F.col("html")), F.lit(_ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("place", "tag"))
    return rows.select("page_id", "place", _attribute(_opening(F.col("tag")), "href").alias("href"), _inner(F.col("tag")).alias("text")).where("href is not null")


def section_links(pages: DataFrame, accept: str = r"^https?://", least: int = 15) -> DataFrame:
    """page_id, url, text, place of a section page's articles.  If an accepted link is in a heading, only headings count;
    else the longest text of each url.  Texts under ``least`` characters go; order of the first appearance."""
    html = visible(F.col("html"))
    anchor = F.lit(_ANCHOR)
    heads = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-4](?=[\s/>])[^>]*+(?:>.*?(?:</h[1-4]\s*+>|\z)|\z)"), F.lit(0)), lambda h: F.regexp_extract_all(h, anchor, F.lit(0))))
    read = lambda tags: F.filter(F.transform(tags, lambda t: F.struct(_attribute(_opening(t), "href").alias("url"), _inner(t).alias("text"))), lambda x: x["url"].rlike(accept))
    wrapped = read(F.filter(F.regexp_extract_all(html, anchor, F.lit(0)), lambda a: a.rlike(r"(?is)^<a\b[^>]*+>\s*+<h[1-4]\b")))
    p = pages.select("page_id", F.concat(read(heads), wrapped).alias("heads"), read(F.regexp_extract_all(html, anchor, F.lit(0))).alias("every"))
    rows = p.select("page_id", F.posexplode(F.when(F.size("heads") > 0, F.col("heads")).otherwise(F.col("every"))).alias("place", "x")).select("page_id", "place", "x.*").where(F.length("text") >= least)
    return rows.groupBy("page_id", "url").agg(F.max_by("text", F.struct(F.length("text"), (-F.col("place")).alias("p"))).alias("text"), F.min("place").alias("place"))


def references(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """page_id, host, url: links from a page to other known outlets.  hosts: host, media_id."""
    own = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    found = links(pages).join(pages.select("page_id", own.alias("own")), "page_id").withColumn("host", F.regexp_replace(F.lower(F.regexp_extract("href", r"^https?://([^/?#:]+)", 1)), r"^(www|m)\.", ""))
    return found.join(hosts, "host").where(F.regexp_replace("own", r"^(www|m)\.", "") != F.col("host")).select("page_id", "host", "media_id", canonical_url(F.col("href")).alias("url")).distinct()


def channel_posts(channels: DataFrame) -> DataFrame:
    """Posts of public channel pages (handle, html): external_id, text with its line breaks, links (20 at most),
    preview_title, preview_text, forwarded_from, views, edited, posted_at."""
    every = F.split("html", r"(?i)<div[^>]*class=\"tgme_widget_message_wrap")
    chunks = F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))
    d = channels.select("handle", F.explode(chunks).alias("x"))
    part = lambda pattern, group=1: F.nullif(F.regexp_extract("x", pattern, group), F.lit(""))
    body = part(r"(?is)<div[^>]*tgme_widget_message_text[^>]*>(.*?)</div>")
    lines = F.array_join(F.transform(F.split(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), "\n"), strip_html), "\n")
    hrefs = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)), lambda t: _attribute(t, "href"))), lambda u: u.rlike(r"(?i)^https?://"))
    out = d.select(
        "handle", part(r"data-post=\"([^\"/]+)/\d+\"").alias("owner"), part(r"data-post=\"[^\"/]+/(\d+)\"").alias("external_id"), F.regexp_replace(lines, "\n{3,}", "\n\n").alias("text"), F.slice(F.coalesce(hrefs, F.array().cast("array<string>")), 1, 20).alias("links"),
        strip_html(part(r"(?is)link_preview_title[^>]*>(.*?)</div>")).alias("preview_title"), strip_html(part(r"(?is)link_preview_description[^>]*>(.*?)</div>")).alias("preview_text"), strip_html(part(r"(?is)forwarded_from_name[^>]*>(.*?)</(?:a|span)>")).alias("forwarded_from"),
        compact_count(part(r"(?is)tgme_widget_message_views\">([^<]*)<")).alias("views"), F.col("x").rlike(r"(?i)message_meta[^>]*>\s*edited").alias("edited"), F.try_to_timestamp(part(r"datetime=\"([^\"]+)\"")).cast("timestamp_ntz").alias("posted_at"),
    )
    return out.where((F.lower("owner") == F.lower("handle")) & F.col("external_id").isNotNull() & F.col("posted_at").isNotNull()).drop("owner")


def imported_posts(rows: DataFrame) -> DataFrame:
    """Posts of an export, whichever of the usual names its fields have.  rows: one VARIANT column ``v``."""
    text = lambda *paths: F.coalesce(*(F.try_variant_get("v", f"$.{p}", "string") for p in paths))
    body = text("full_text", "text", "tweet.full_text", "legacy.full_text", "content")
    urls = F.coalesce(*(F.try_variant_get("v", f"$.{p}", "array<struct<expanded_url: string>>") for p in ("entities.urls", "tweet.entities.urls", "legacy.entities.urls")), F.array().cast("array<struct<expanded_url: string>>"))
    from ..functions.time import any_datetime

    out = rows.select(text("id_str", "id", "tweet.id_str", "rest_id").alias("external_id"), F.lower(text("user.screen_name", "author.username", "username", "screen_name")).alias("handle"), body.alias("text"), F.transform(urls, lambda u: u["expanded_url"]).alias("links"), any_datetime(text("created_at", "tweet.created_at", "date")).alias("posted_at"), F.coalesce(F.startswith(body, F.lit("RT @")), F.lit(False)).alias("is_repost"))
    return out.where("external_id is not null and text is not null").dropDuplicates(["handle", "external_id"])
