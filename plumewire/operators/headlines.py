"""Headline history: transitions inside a source, change statistics, change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import headline_changes, headline_facts
from ..functions.time import seconds


def transitions(versions: DataFrame) -> DataFrame:
    """Each version with its predecessor in the same article and source, and what changed.
    versions: id, article_id, subsource_id, title, subtitle, detected_at."""
    w = Window.partitionBy("article_id", "subsource_id").orderBy("detected_at", "id")
    before = versions.withColumn("facts", headline_facts(F.col("title"))).withColumns({"old_facts": F.lag("facts").over(w), "old_title": F.lag("title").over(w), "old_subtitle": F.lag("subtitle").over(w), "old_at": F.lag("detected_at").over(w), "first_at": F.first("detected_at").over(w), "place": F.row_number().over(w)})
    return before.where("place > 1").withColumn("changes", headline_changes(F.col("old_facts"), F.col("facts"), F.col("old_subtitle"), F.col("subtitle"))).drop("place", "facts", "old_facts")


def change_stats(versions: DataFrame, articles: DataFrame) -> DataFrame:
    """media_id, articles, changed, changes, cross_source_variants, median_first_change (minutes)."""
    t = transitions(versions).where(F.size("changes") > 0)
    first = t.groupBy("article_id").agg(F.count("*").alias("changes"), F.min_by((seconds(F.col("detected_at")) - seconds(F.col("first_at"))) / 60.0, F.struct("first_at", "subsource_id", "detected_at", "id")).alias("minutes"))
    variants = versions.groupBy("article_id").agg(F.count_distinct(F.coalesce(F.col("subsource_id").cast("string"), F.lit(""))).alias("sources"), F.count_distinct(F.struct(F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit("")))).alias("texts"))
    a = articles.select(F.col("id").alias("article_id"), "media_id").join(first, "article_id", "left").join(variants, "article_id", "left")
    return a.groupBy("media_id").agg(
        F.count("*").alias("articles"), F.count("changes").alias("changed"), F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"), F.count_if((F.col("sources") > 1) & (F.col("texts") > 1)).alias("cross_source_variants"), F.bround(F.median("minutes"), 0).alias("median_first_change")
    )


def category_counts(versions: DataFrame) -> DataFrame:
    """category, n."""
    return transitions(versions).select(F.explode("changes").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def change_list(versions: DataFrame, category: str | None = None, limit: int = 200) -> DataFrame:
    """The newest changes, of one category if asked."""
    t = transitions(versions).where(F.size("changes") > 0)
    t = t if category is None else t.where(F.array_contains("changes", category))
    return t.orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)
