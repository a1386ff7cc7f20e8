"""Which rows a list, a job or a reviewer gets: visible articles, filters, orders with nulls last, pages and their
impressions, pages to fetch, pairs to send to a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import CANDIDATE_TYPES
from ..functions.text import has_words, term_pattern, search_text
from ..functions.time import hours_before

PERIODS = {"24h": 24, "72h": 72, "7d": 168, "30d": 720}
ENRICH_HOURS, ENRICH_ATTEMPTS = 48, 3
CANDIDATE_HOURS = 72


def visible(articles: DataFrame, demo: bool = False, hidden: bool | None = False) -> DataFrame:
    """Articles without made-up ones (unless ``demo``), and without those hidden by hand; ``hidden`` True gives only the
    hidden ones, None all.  A null ``is_demo`` counts as false.  articles: is_demo, hidden_at."""
    out = articles if demo else articles.where(~F.coalesce("is_demo", F.lit(False)))
    if hidden is None:
        return out
    return out.where(F.col("hidden_at").isNotNull() if hidden else F.col("hidden_at").isNull())


def filtered(
    articles: DataFrame, now: Column | None = None, *, media: str | None = None, hits: DataFrame | None = None, words: str = "", section: str | None = None, signed: bool | None = None,
    period: str | None = None, related: DataFrame | None = None, least_clicks: int = 0, text: str = "search_text",
) -> DataFrame:
    """The articles that pass every filter given.  ``hits`` (id) are those of a topic, ``words`` must all be in the text,
    ``signed`` asks for an author or for none (null and empty are none), ``period`` counts back from ``now`` (an unknown
    one is no filter), ``related`` (a, b) asks for a relation at either end.  A null never passes a filter on its column."""
    out = articles
    if media is not None:
        out = out.where(F.col("media_id") == media)
    if section is not None:
        out = out.where(F.col("section") == section)
    if signed is not None:
        has = F.coalesce("author", F.lit("")) != ""
        out = out.where(has if signed else ~has)
    if period in PERIODS:
        out = out.where(F.col("first_seen_at") >= hours_before(now, PERIODS[period]))
    if least_clicks > 0:
        out = out.where(F.col("clicks") >= least_clicks)
    if words.strip():
        out = out.where(has_words(F.col(text), words))
    if hits is not None:
        out = out.join(hits.select("id"), "id", "left_semi")
    if related is not None:
        ends = related.select(F.explode(F.array("a", "b")).alias("id"))
        out = out.join(ends, "id", "left_semi")
    return out


def without_terms(groups: DataFrame, titles: DataFrame, terms: list[str]) -> DataFrame:
    """The groups in whose titles (group_id, title) no term stands as whole words; blank terms count for nothing."""
    pattern = term_pattern(terms)
    if pattern is None:
        return groups
    named = titles.where(search_text(F.col("title")).rlike(pattern)).select("group_id")
    return groups.join(named, "group_id", "left_anti")


def group_order(order: str = "medios") -> list[Column]:
    """How a list of groups is sorted; groups without a date come last either way."""
    newest, last = F.desc_nulls_last("first_seen_at"), F.desc("group_id")
    return {
        "recientes": [newest, last], "notas": [F.desc("articles"), newest, last], "actualizados": [F.desc_nulls_last("updated_at"), last], "antiguos": [F.asc_nulls_last("first_seen_at"), last],
    }.get(order, [F.desc("media"), newest, last])


def alert_order(order: str | None = None, status: str = "pendiente") -> list[Column]:
    """How a list of alerts is sorted: pending ones by priority, others by what is new, unless asked otherwise."""
    news, last = F.coalesce("last_material_change_at", "created_at"), F.desc("id")
    rank = F.when(F.col("priority") == "alta", 0).when(F.col("priority") == "media", 1).when(F.col("priority") == "baja", 2).otherwise(9)
    newest = news.desc_nulls_last()
    orders = {"novedad": [newest, last], "novedad_asc": [news.asc_nulls_last(), last], "prioridad": [rank, newest, last], "notas": [F.desc("articles"), newest, last], "medios": [F.desc("media"), newest, last]}
    return orders.get(order, orders["prioridad" if status == "pendiente" else "novedad"])


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered list with each row's place in the whole list; only as many rows as there are up to its end
    are ever sorted in one place."""
    first = (max(number, 1) - 1) * size
    shown = rows.orderBy(*order).offset(first).limit(size)
    return shown.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) + first).cast("long"))


def impressions(shown: DataFrame, user_id: int, context: str, now: Column) -> DataFrame:
    """What is recorded of a page (id, rank) that a reader was shown; ``merges.record_interactions`` takes it in."""
    return shown.select(F.col("id").alias("article_id"), F.lit(user_id).cast("long").alias("user_id"), F.lit("impresion").alias("event"), F.lit(context).alias("context"), "rank", now.alias("created_at"))


def enrich_targets(articles: DataFrame, hits: DataFrame, now: Column, per_media: int, sections: list[str] | None = None) -> DataFrame:
    """Articles whose page is worth fetching: new, known from a feed only, not tried too often, and without a subtitle, in
    a section that matters or with a topic (hits: id); the newest of each outlet, ties by the larger id.
    articles: id, media_id, is_demo, extraction_status, enrich_attempts, first_seen_at, subtitle, section.  Null attempts
    are none; a null outlet is an outlet of its own."""
    fresh = articles.where(
        ~F.coalesce("is_demo", F.lit(False)) & (F.col("extraction_status") == "feed_only") & (F.coalesce("enrich_attempts", F.lit(0)) < ENRICH_ATTEMPTS) & (F.col("first_seen_at") >= hours_before(now, ENRICH_HOURS))
    )
    on_topic = fresh.join(hits.select("id").distinct().withColumn("on_topic", F.lit(True)), "id", "left")
    wanted = F.col("subtitle").isNull() | F.col("on_topic").isNotNull()
    if sections:
        wanted = wanted | F.coalesce(F.col("section").isin(*sections), F.lit(False))
    newest = Window.partitionBy("media_id").orderBy(F.desc("first_seen_at"), F.desc("id"))
    return on_topic.where(wanted).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= per_media).drop("on_topic")


def both_ends(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations (a, b) with both ends among the ids."""
    ends = ids.select(F.col("id").alias("end")).distinct()
    out = relations
    for side in ("a", "b"):
        out = out.join(ends, F.col(side) == F.col("end"), "left_semi")
    return out


def newest_of_pairs(analyses: DataFrame, *columns: str) -> DataFrame:
    """low, high, newest: the newest good analysis of two articles as a struct of created_at, id and the columns; ties go to
    the larger id.  analyses: id, a, b, status, created_at."""
    good = analyses.where((F.col("status") == "ok") & F.col("a").isNotNull() & F.col("b").isNotNull())
    return good.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max(F.struct("created_at", "id", *columns)).alias("newest"))


def latest_of_pairs(pairs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each pair (a, b) with the newest good analysis of its two articles, whichever came first there; null where there is
    none.  analyses: id, a, b, status, created_at; ties go to the larger id.  A pair with a null has none."""
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    newest = newest_of_pairs(analyses).select("low", "high", F.col("newest.id").alias("analysis_id"))
    asked = pairs.where("a is not null and b is not null").select("a", "b").distinct().select("a", "b", low, high)
    return asked.join(newest, ["low", "high"], "left").select("a", "b", "analysis_id")


def analysis_candidates(relations: DataFrame, articles: DataFrame, members: DataFrame, alerts: DataFrame, now: Column, limit: int, priority: int = 0) -> DataFrame:
    """Pairs to send to a language model, in the order of ``place``: of the kinds that are worth it, changed in the last
    hours and not rejected; the best ten times ``limit`` of them, without made-up articles, and, from a ``priority`` above 0,
    only with both articles in groups with a pending alert of at least that priority.  Pairs that pending alerts hold come
    first, then by score (none is the lowest; ties by a, b and kind).

    relations: a, b, relation_type, score, review_status, created_at, updated_at; articles: id, is_demo; members: group_id,
    id, active; alerts: group_id, status, priority.  A null review status is no rejection."""
    recent = relations.where(F.col("relation_type").isin(*CANDIDATE_TYPES) & (F.coalesce("review_status", F.lit("")) != "rechazada") & (F.coalesce("updated_at", "created_at") >= hours_before(now, CANDIDATE_HOURS)))
    order = [F.desc_nulls_last("score"), F.asc("a"), F.asc("b"), F.asc("relation_type")]
    best = recent.orderBy(*order).limit(limit * 10)
    real = both_ends(best, articles.where(~F.coalesce("is_demo", F.lit(False))))
    pending = alerts.where("status = 'pendiente'").groupBy("group_id").agg(F.max("priority").alias("priority"))
    held = members.where("active").join(pending, "group_id").groupBy("id").agg(F.max("priority").alias("held"))
    for side in ("a", "b"):
        real = real.join(held.select(F.col("id").alias(side), F.col("held").alias(f"{side}_held")), side, "left")
    if priority > 0:
        real = real.where((F.col("a_held") >= priority) & (F.col("b_held") >= priority))
    alerted = F.col("a_held").isNotNull() & F.col("b_held").isNotNull()
    first = Window.orderBy(F.desc("alerted"), *order)  # at most ten times ``limit`` rows
    out = real.withColumn("alerted", alerted).withColumn("place", F.row_number().over(first))
    return out.select("place", "a", "b", "relation_type", "score", "alerted")
