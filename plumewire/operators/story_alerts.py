"""Whether a story is worth an alert: independent outlets, exclusions, priority by the strongest evidence, warnings, what
coincides, and a fingerprint of what matters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm, once
from ..functions.time import seconds
from .common_source import common_sources
from .selection import newest_of_pairs
from .shared import kept

LEVELS = ["baja", "media", "alta"]
EXPRESSION_TYPES = ["titular_identico", "titular_casi_identico", "expresion_compartida"]
TOPIC = "tema compartido"
FOCUS = "enfoque similar respaldado por análisis (IA, pendiente de confirmación humana)"
EXPRESSION = "expresión distintiva o titular compartido"
CAREFUL = "con afirmaciones distintas: revisar antes de interpretar"


@dataclass(frozen=True)
class Rules:
    """What an alert needs.  Priorities are places in ``LEVELS``; sections are in lower case."""

    least_media: int = 2
    shared_topic: int = 0
    same_event: int = 1
    shared_expression: int = 2
    same_event_hours: int = 24
    least_priority: int = 0
    excluded_terms: tuple[str, ...] = ()
    excluded_sections: tuple[str, ...] = ("deportes", "espectaculos", "show", "teleshow", "famosos")


def _articles(members: DataFrame) -> DataFrame:
    """Active members without made-up ones, or all of them where a group has no others; only made-up ones are looked up."""
    demo = F.coalesce("is_demo", F.lit(False))
    active = members.where("active and group_id is not null").withColumn("is_syndicated", F.coalesce("is_syndicated", F.lit(False)))
    real = active.where(~demo)
    return real.unionByName(kept(active.where(demo).join(real.select("group_id"), "group_id", "left_anti")))


def _told(arts: DataFrame, rules: Rules) -> DataFrame:
    own, timed = ~F.col("is_syndicated"), (F.col("published_precision") == "datetime") & F.col("published_at").isNotNull()
    one = F.struct("id", "media_name", "origin_label", "author", "is_syndicated", "title", "url", F.when(timed | (F.col("published_precision") == "date"), F.col("published_at")).alias("published_at"), F.coalesce("published_precision", F.lit("none")).alias("precision"), "first_seen_at")
    seen = F.struct(F.col("first_seen_at").isNull().alias("undated"), "first_seen_at", "id")
    out = arts.groupBy("group_id").agg(
        F.count("*").alias("notes"), F.sort_array(F.collect_set(F.when(own, F.col("media_id")))).alias("media_ids"), F.sort_array(F.collect_set(F.when(own, F.col("media_name")))).alias("media"),
        F.bool_and(F.lower(F.coalesce("section", F.lit(""))).isin(*rules.excluded_sections)).alias("off_section") if rules.excluded_sections else F.lit(False).alias("off_section"),
        F.sort_array(F.collect_list(F.struct(seen.alias("at"), one.alias("one")))).alias("articles"), F.sort_array(F.collect_list(F.struct(seen.alias("at"), "title"))).alias("titles"), F.count(F.when(timed, 1)).alias("timed"),
        F.min_by(F.struct("id", "media_name", "first_seen_at"), seen).alias("first_detected"), F.min_by(F.struct("id", "media_name", "published_at"), F.when(timed, F.struct("published_at", "id"))).alias("first_published"),
    )
    return out.withColumns({"articles": F.col("articles.one"), "titles": F.array_join("titles.title", " ")})


def _between_outlets(arts: DataFrame, relations: DataFrame, analyses: DataFrame, rules: Rules) -> DataFrame:
    """A row for each relation of two outlets' own articles in a group, with the priority that it asks for and why."""
    end = lambda s: arts.where("not is_syndicated").select("group_id", F.col("id").alias(s), F.col("media_id").alias(f"{s}_media"), F.col("media_name").alias(f"{s}_name"), F.col("first_seen_at").alias(f"{s}_seen"))
    held = relations.where(F.coalesce("review_status", F.lit("")) != "rechazada").withColumnRenamed("id", "relation_id").select("relation_id", "a", "b", "relation_type", "score", "review_status", "delta_seconds", "notes", "phrases", "rules")
    rel = held.join(end("a"), "a").join(end("b"), ["group_id", "b"]).where(~F.col("a_media").eqNullSafe(F.col("b_media")))
    done = newest_of_pairs(analyses, "same_event", "focus", "flags").select("low", "high", F.col("newest.id").alias("analysis_id"), "newest.same_event", "newest.focus", "newest.flags")
    rel = rel.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(done, ["low", "high"], "left")
    rel = rel.withColumn("supported", (F.col("same_event") == "si") & (F.col("focus") == "similar") & (F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0))
    known = F.col("delta_seconds").isNotNull()
    hours = F.abs(F.when(known, F.col("delta_seconds")).otherwise(seconds(F.col("b_seen")) - seconds(F.col("a_seen")))) / 3600
    near = (F.col("relation_type") == "mismo_hecho") & (hours <= rules.same_event_hours)
    because = F.concat(F.lit("mismo hecho a "), F.bround(hours, 0).cast("long").cast("string"), F.when(known, " h (según publicación)").otherwise(" h (según detección)"))
    expression = F.col("relation_type").isin(*EXPRESSION_TYPES)
    rank = F.when(F.col("supported") | expression, rules.shared_expression).when(near, rules.same_event)
    reason = F.when(F.col("supported"), FOCUS).when(expression, EXPRESSION).when(near, because)
    noted = F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.contains(n, F.lit("negación")) | F.contains(n, F.lit("dejó de")))
    differ = F.concat(F.lit("Afirmaciones distintas entre "), F.coalesce("a_name", F.lit("")), F.lit(" y "), F.coalesce("b_name", F.lit("")), F.lit(": no es el mismo mensaje."))
    warned = F.concat(noted, F.when(F.col("relation_type") == "afirmaciones_distintas", F.array(differ)).otherwise(F.array().cast("array<string>")))
    flags = F.size(F.coalesce("flags", F.array().cast("array<string>")))
    seen = F.when(F.col("analysis_id").isNotNull(), F.struct("relation_id", F.coalesce("focus", F.lit("")).alias("focus"), flags.alias("flags")))
    return rel.select("group_id", "relation_id", "a", "b", "relation_type", "score", "review_status", "rules", F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"), rank.alias("rank"), reason.alias("reason"), warned.alias("warned"), seen.alias("analysis"))


def _found(rel: DataFrame) -> DataFrame:
    """What a group's relations say, each thing by itself, so that only what is asked for is collected; lists of one thing
    are in the order of the relations."""
    listed = lambda test, *what: F.sort_array(F.collect_list(F.when(test, F.struct("relation_id", "a", "b", "relation_type", *what))))
    best = F.struct((-F.col("score")).alias("key"), F.col("relation_id").alias("id"), "relation_type", "score", "review_status", "rules", "a", "b")
    return rel.withColumn("score", F.coalesce("score", F.lit(0.0))).groupBy("group_id").agg(
        F.count("*").alias("related"), F.max("rank").alias("rank"), listed(F.col("reason").isNotNull(), "rank", "reason").alias("asked"), listed(F.size("warned") > 0, "warned").alias("warned"), listed(F.size("phrases") > 0, "phrases").alias("said"),
        F.collect_set(F.struct("relation_type")).alias("types"), F.sort_array(F.collect_list("analysis")).alias("analyses"), F.sort_array(F.collect_list(best)).alias("best"),
    )


def evaluate(groups: DataFrame, members: DataFrame, relations: DataFrame, analyses: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each group: ``skip``, why there is no alert (null if there is one), ``priority`` (place in ``LEVELS``) and
    ``level``, ``reasons``, ``warnings``, the evidence, and ``fingerprint``, which changes only with what matters.

    The priority is the highest that a relation between two outlets' own articles asks for: a shared expression or title, a
    similar focus that the pair's newest analysis supports, the same event within some hours; else that of a shared topic.
    The first rule that a group fails gives ``skip``.  Everything listed is of one story, whose size ``groups.cluster``
    bounds; relations are joined to their groups by both ends.  The members are read several times: store them where they
    are costly to make.

    groups: group_id, title, terms, phrases; members: group_id, id, active, media_id, media_name, title, subtitle, author,
    section, is_demo, is_syndicated, origin_label, url, published_at, published_precision, first_seen_at; relations: id, a,
    b, relation_type, score, review_status, delta_seconds, notes, phrases, rules; analyses: id, a, b, status, created_at,
    same_event, focus, flags.  Nulls count as empty; a null review is no rejection, a null flag is false."""
    arts = _articles(members)
    found = _found(_between_outlets(arts, relations, analyses, rules))
    signs = common_sources(arts).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("kind", "n", "ids", "evidence"))).alias("sources"))
    g = groups.select("group_id", F.col("title").alias("group_title"), F.col("terms").alias("group_terms"), F.col("phrases").alias("group_phrases"))
    x = g.join(_told(arts, rules), "group_id", "left").join(found, "group_id", "left").join(signs, "group_id", "left")
    none = F.array().cast("array<string>")
    empty = {n: F.coalesce(n, F.array().cast(found.schema[n].dataType)) for n in ("asked", "warned", "said", "types", "analyses", "best")}
    x = x.withColumns(empty | {"sources": F.coalesce("sources", F.array().cast(signs.schema["sources"].dataType)), "media_ids": F.coalesce("media_ids", F.array()), "group_terms": F.coalesce("group_terms", none), "group_phrases": F.coalesce("group_phrases", none)})
    x = x.withColumns({
        "priority": F.greatest(F.lit(rules.shared_topic), F.coalesce("rank", F.lit(rules.shared_topic))), "warnings": F.array_distinct(F.flatten("warned.warned")), "phrases": F.array_distinct(F.concat(F.flatten("said.phrases"), "group_phrases")),
        "types": F.array_sort("types.relation_type"),
    })
    asked = F.transform(F.filter("asked", lambda i: i["rank"] == F.col("priority")), lambda i: i["reason"])
    reasons = F.array_distinct(F.concat(F.when(F.col("priority") == rules.shared_topic, F.array(F.lit(TOPIC))).otherwise(none), asked))
    first5 = F.array_sort(F.slice("phrases", 1, 5))
    kinds = F.transform("sources", lambda s: s["kind"])
    matters = F.struct("media_ids", "priority", "types", first5.alias("phrases"), kinds.alias("sources"), (F.size("warnings") > 0).alias("warned"), "analyses")
    return x.select(
        "group_id", _skip(rules).alias("skip"), "priority", F.get(F.array(*map(F.lit, LEVELS)), F.col("priority")).alias("level"), F.concat(reasons, F.when(F.size("warnings") > 0, F.array(F.lit(CAREFUL))).otherwise(none)).alias("reasons"), "warnings",
        F.slice("phrases", 1, 8).alias("phrases"), F.slice("group_terms", 1, 8).alias("terms"), F.transform(F.slice("best", 1, 20), lambda i: i.dropFields("key")).alias("relations"), "articles", F.coalesce("notes", F.lit(0)).alias("notes"), "media_ids", "media", "types", "sources", "analyses",
        "first_detected", "first_published", F.coalesce("timed", F.lit(0)).alias("timed"), matters.alias("material"), F.sha2(F.to_json(matters), 256).alias("fingerprint"),
    )


def _skip(rules: Rules) -> Column:
    """The words of a story are made plain only where no earlier rule has spoken, and once for all terms."""
    out = F.when(F.coalesce("notes", F.lit(0)) < 2, "menos de dos notas").when(F.size("media_ids") < rules.least_media, "menos medios independientes que el mínimo").when(F.col("off_section"), "sección excluida")
    last = F.when(F.coalesce("related", F.lit(0)) == 0, "sin relaciones entre medios independientes").when(F.col("priority") < rules.least_priority, "prioridad menor que la mínima configurada")
    terms = [t for t in rules.excluded_terms if t.strip()]
    if not terms:
        return out.otherwise(last)
    told = norm(F.concat_ws(" ", "group_title", F.array_join("group_terms", " "), F.array_join("group_phrases", " "), "titles"))
    named = once(told, lambda said: F.coalesce(*(F.when(F.contains(said, norm(F.lit(t))), f"término excluido: {t}") for t in terms)))
    return out.otherwise(F.coalesce(named, last))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """group_id, changed: what differs between a group's stored and new evaluation (group_id, material): outlets or phrases
    that came in, priority, kinds of relation, common sources, warnings, analyses.  Outlets or phrases that went are no
    change.  Groups on one side only are left out."""
    o, n = old.select("group_id", F.col("material").alias("o")), new.select("group_id", F.col("material").alias("n"))
    came = lambda c: F.size(F.array_except(f"n.{c}", f"o.{c}")) > 0
    differs = lambda c: ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    every = {"media": came("media_ids"), "priority": differs("priority"), "phrases": came("phrases"), "types": differs("types"), "sources": differs("sources"), "warnings": differs("warned"), "analyses": differs("analyses") & (F.size("n.analyses") > 0)}
    named = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in every.items())), lambda x: x.isNotNull())
    return o.join(n, "group_id").select("group_id", named.alias("changed"))
