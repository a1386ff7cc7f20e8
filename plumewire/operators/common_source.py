"""What the articles of a group may all go back to: a report, a press conference, an agency, an interview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import COMMON_SOURCES
from ..functions.text import norm


def common_sources(articles: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """group_id, kind, n, ids, evidence: kinds of source that at least two articles of a group show, or one for an agency.
    An article's evidence is what the first pattern of the kind finds in its title, subtitle and author; one taken over
    from an agency without such words shows it by its label.  A hint, not a finding.

    articles: group_id, id, title, subtitle, author, is_syndicated, origin_label.  Rows without a group are left out, nulls
    count as empty, an article twice in a group counts once.  Only articles with evidence are shuffled; a group is a story
    of ``groups.cluster``, whose size is bounded, and only its ids with evidence are listed."""
    patterns = COMMON_SOURCES if patterns is None else patterns
    told = norm(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("subtitle", F.lit("")), F.nullif("author", F.lit(""))))
    found = lambda rx: F.nullif(F.regexp_extract("told", f"(?U){rx}", 0), F.lit(""))
    label = F.coalesce(F.nullif("origin_label", F.lit("")), F.nullif("author", F.lit("")), F.lit("agencia"))
    taken = F.when(F.coalesce("is_syndicated", F.lit(False)), F.concat(F.lit("republicación ("), label, F.lit(")")))
    first = {kind: F.coalesce(*map(found, several), F.lit(None).cast("string")) for kind, several in patterns.items()}
    first["agencia"] = F.coalesce(first.get("agencia", F.lit(None).cast("string")), taken)
    signs = F.filter(F.array(*(F.struct(F.lit(kind).alias("kind"), c.alias("sign")) for kind, c in first.items())), lambda x: x["sign"].isNotNull())
    rows = articles.where("group_id is not null").withColumn("told", told).select("group_id", "id", F.inline(signs))
    out = rows.groupBy("group_id", "kind").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("sign")).alias("evidence"))
    return out.where((F.size("ids") >= 2) | ((F.col("kind") == "agencia") & (F.size("ids") >= 1))).select("group_id", "kind", F.size("ids").cast("long").alias("n"), "ids", "evidence")
