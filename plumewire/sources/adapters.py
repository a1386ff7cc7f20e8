"""Outlets' own rules as rows: an outlet is added by rows of a table, not by code.

Rules: domain, field, pattern, value, priority.  A rule is for the addresses of its domain and of what is under it (the
longest domain that has rules counts).  Fields: ``article`` (what the path of an article looks like; other addresses are
left out), ``section``, ``source_id``, ``origin`` (a label that makes an article a copy of another outlet's), ``author`` (text
to take off the signature).  The pattern is looked for in the path, for origin and author in the signature; the value is
the label, or null for what the pattern's first group found.  Of several rules of one field the first that matches counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..operators.mentions import host_of

# What every outlet has, after its own rules.
DEFAULTS = [("section", r"^/([^/]+)/", None), ("author", r"(?i)^\s*por(?:\s+|$)", None)]


def signature(raw: Column) -> Column:
    """A signature without markup, the word before it and signs around it; null if nothing is left."""
    text = F.regexp_replace(strip_html(raw), r"(?i)^\s*por(?:\s+|$)", "")
    return F.nullif(F.regexp_replace(text, r"^[ ,;:-]+|[ ,;:-]+$", ""), F.lit(""))


def agency(author: Column, agencies: DataFrame) -> Column:
    """The agency that a signature names; agencies: author (lower case), label, a small table of names."""
    known = {r.author: r.label for r in agencies.limit(1000).collect()}
    key = F.regexp_replace(F.lower(F.trim(author)), r"\.+$", "")
    return F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), key) if known else F.lit(None).cast("string")


def adapted(items: DataFrame, rules: DataFrame, agencies: DataFrame | None = None) -> DataFrame:
    """The items that are articles of an outlet with rules: their columns, and domain, section, source_id, origin_label,
    author (cleaned), is_syndicated (by origin or agency).  items: url, section (of the feed; may be null), author.

    Defined results: an address without a host, or of a host without rules, is left out; an outlet without an article rule
    takes every path; null authors stay null; repeated items stay."""
    keyed = items.withColumn("_row", F.monotonically_increasing_id())
    parts = F.split(host_of(F.col("url")), r"\.")
    under = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    path = F.regexp_extract("url", r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    known = rules.groupBy(F.lower("domain").alias("domain")).agg(F.array_sort(F.collect_list(F.struct("priority", "field", "pattern", "value"))).alias("rules"))
    places = keyed.select("_row", F.posexplode(under).alias("depth", "domain")).join(known, "domain")
    nearest = places.groupBy("_row").agg(F.min_by(F.struct("domain", "rules"), "depth").alias("d"))
    held = keyed.join(nearest, "_row").withColumns({"_path": path, "_author": signature(F.col("author"))})
    own = lambda field: F.filter("d.rules", lambda r: r["field"] == field)

    def first(field: str, text: Column) -> Column:
        hit = F.get(F.filter(own(field), lambda r: F.coalesce(F.regexp_like(text, r["pattern"]), F.lit(False))), 0)
        return F.coalesce(hit["value"], F.nullif(F.call_function("regexp_extract", text, F.coalesce(hit["pattern"], F.lit("$^()")), F.when(F.contains(F.coalesce(hit["pattern"], F.lit("()")), F.lit("(")), 1).otherwise(0)), F.lit("")))

    cut = F.aggregate(own("author"), F.col("_author"), lambda text, r: F.regexp_replace(text, r["pattern"], F.lit("")))
    section = F.coalesce(first("section", F.col("_path")), F.nullif(F.lower(F.regexp_extract("_path", DEFAULTS[0][1], 1)), F.lit("")), F.col("section"))
    is_article = (F.size(own("article")) == 0) | F.exists(own("article"), lambda r: F.regexp_like(F.col("_path"), r["pattern"]))
    origin = first("origin", F.coalesce(F.col("_author"), F.lit("")))
    by_agency = agency(F.col("_author"), agencies) if agencies is not None else F.lit(None).cast("string")
    out = held.where(is_article).withColumns({"_section": section, "_source": first("source_id", F.col("_path")), "_origin": F.coalesce(origin, by_agency), "_clean": F.nullif(F.trim(cut), F.lit(""))})
    rest = [c for c in items.columns if c not in ("section", "author")]
    return out.select(*rest, F.col("d.domain").alias("domain"), F.col("_section").alias("section"), F.col("_source").alias("source_id"), F.col("_origin").alias("origin_label"), F.col("_clean").alias("author"), F.col("_origin").isNotNull().alias("is_syndicated"))
