"""The report of a period: every figure that comes from the articles in one pass over them, by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import time

# Fixed value: how exactly a time of publication may be known.
PRECISIONS = ["datetime", "date", "none"]


def period_figures(articles: DataFrame, since: Column, until: Column, tz: str = "UTC") -> DataFrame:
    """section, media_id, day, precision, n, own, syndicated, signed, before: the figures of all sections of a report.

    Sections: total; media (by outlet); days (by local day); day_media; precision (by outlet and precision, A13's table).
    before is the number of articles in the period of equal length before; days are told within the period alone.
    articles: media_id, first_seen_at, is_syndicated, published_precision, author (null or empty: unsigned)."""
    at = time.seconds(F.col("first_seen_at"))
    start, end = time.seconds(since), time.seconds(until)
    now = (at >= start) & (at < end)
    a = articles.where((at >= 2 * start - end) & (at < end)).select(
        "media_id", F.when(now, time.local_day(F.col("first_seen_at"), tz)).alias("day"), F.when(now, F.coalesce("published_precision", F.lit("none"))).alias("precision"), now.alias("now"), "is_syndicated", (F.length(F.trim(F.coalesce("author", F.lit("")))) > 0).alias("signed")
    )
    sets = [[], ["media_id"], ["day"], ["media_id", "day"], ["media_id", "precision"]]
    names = {7: "total", 3: "media", 5: "days", 1: "day_media", 2: "precision"}
    found = a.groupingSets([[F.col(c) for c in s] for s in sets], "media_id", "day", "precision").agg(
        F.grouping_id().alias("g"), F.count_if("now").alias("n"), F.count_if(F.col("now") & ~F.col("is_syndicated")).alias("own"), F.count_if(F.col("now") & F.col("is_syndicated")).alias("syndicated"),
        F.count_if(F.col("now") & F.col("signed")).alias("signed"), F.count_if(~F.col("now")).alias("before"),
    )
    section = F.element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v)))), F.col("g").cast("int"))
    rows = found.withColumn("section", section).where(~(F.col("section").isin("days", "day_media") & F.col("day").isNull()) & ~((F.col("section") == "precision") & F.col("precision").isNull()))
    return rows.select("section", "media_id", "day", "precision", "n", "own", "syndicated", "signed", "before")


def review_counts(reviews: DataFrame, since: Column, until: Column) -> DataFrame:
    """target, decision, n of the decisions of a period, the open ones left out.  reviews: target, decision, at."""
    at = time.seconds(F.col("at"))
    inside = reviews.where((at >= time.seconds(since)) & (at < time.seconds(until)) & (F.col("decision") != "pendiente"))
    return inside.groupBy("target", "decision").agg(F.count("*").alias("n"))


def own_notes(articles: DataFrame, members: DataFrame, since: Column, until: Column, top: int = 40) -> DataFrame:
    """media_id, own_total, id, place: an outlet's own articles of a period that are in no group with another independent
    outlet, the ``top`` newest of each (ties: larger id), and how many there are.  members: id, group_id, of open groups."""
    at = time.seconds(F.col("first_seen_at"))
    own = articles.where((at >= time.seconds(since)) & (at < time.seconds(until)) & ~F.col("is_syndicated"))
    wide = members.join(articles.where("not is_syndicated").select("id", "media_id"), "id").groupBy("group_id").agg(F.count_distinct("media_id").alias("k")).where("k > 1").select("group_id")
    shared = members.join(wide, "group_id").select("id").distinct()
    alone = own.join(shared, "id", "left_anti").select("media_id", "id", "first_seen_at")
    total = alone.groupBy("media_id").agg(F.count("*").alias("own_total"))
    newest = Window.partitionBy("media_id").orderBy(F.desc("first_seen_at"), F.desc("id"))
    return alone.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= top).join(total, "media_id").select("media_id", "own_total", "id", "place")


def period_report(articles: DataFrame, members: DataFrame, reviews: DataFrame, since: Column, until: Column, tz: str = "UTC") -> dict[str, DataFrame]:
    """The parts of a period's report; each reads each of its tables once, and the articles' figures share one pass."""
    return {"figures": period_figures(articles, since, until, tz), "own": own_notes(articles, members, since, until), "reviews": review_counts(reviews, since, until)}
