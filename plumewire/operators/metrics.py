"""Analytic queries over articles, groups and outlets: agenda, sequences, rising topics, funnels, rollups, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, time
from ..functions.text import has_term, search_tokens
from .shared import kept


#: Keywords that are tested in one pass over each text; a larger dictionary is joined by its words instead.
MAX_TERMS = 500


def matching_topics(articles: DataFrame, topics: DataFrame, text: str = "search_text") -> DataFrame:
    """(id, slug, hits): topics with a keyword in the text as whole words and no excluded one.
    topics: slug, keywords, exclude."""
    tokens = articles.select("id", search_tokens(F.col(text)).alias("tokens"))
    term = lambda c, yes: topics.select("slug", F.explode(c).alias("keyword")).select("slug", "keyword", search_tokens(F.col("keyword")).alias("term"), F.lit(yes).alias("yes")).where("trim(term) <> ''")
    terms = term("keywords", True).unionByName(term("exclude", False))
    n = terms.count()
    if n <= MAX_TERMS:
        whole = terms.agg(F.collect_list(F.struct("slug", "keyword", "term", "yes")).alias("terms"))
        found = tokens.crossJoin(F.broadcast(whole)).select("id", F.explode(F.filter("terms", lambda t: F.contains(F.col("tokens"), t["term"]))).alias("t")).select("id", "t.slug", "t.keyword", "t.yes")  # one row of at most MAX_TERMS
    else:
        words = tokens.select("id", F.explode(F.array_distinct(F.split(F.trim("tokens"), " "))).alias("word"))
        maybe = words.join(terms.withColumn("word", F.get(F.split(F.trim("term"), " "), 0)), "word").drop("word")
        found = maybe.join(tokens, "id").where(F.contains("tokens", "term")).select("id", "slug", "keyword", "yes")
    out = found.groupBy("id", "slug").agg(F.array_sort(F.collect_set(F.when(F.col("yes"), F.col("keyword")))).alias("hits"), F.bool_and("yes").alias("ok"))
    return out.where("ok").drop("ok")


def topic_volume(articles: DataFrame, topics: DataFrame, tz: str = "UTC") -> DataFrame:
    """slug, media_id, day, n."""
    found = matching_topics(articles, topics).join(articles.select("id", "media_id", time.local_day(F.col("first_seen_at"), tz).alias("day")), "id")
    return found.groupBy("slug", "media_id", "day").agg(F.count("*").alias("n"))


def topic_change(articles: DataFrame, topics: DataFrame, since: Column, until: Column, top: int = 15) -> DataFrame:
    """slug, n, before (in the period of equal length before), media; the ``top`` first by count, then slug."""
    length = time.seconds(until) - time.seconds(since)
    at = time.seconds(F.col("first_seen_at"))
    found = matching_topics(articles, topics).join(articles, "id")
    now = (F.col("first_seen_at") >= since) & (F.col("first_seen_at") < until)
    before = (at >= time.seconds(since) - length) & (F.col("first_seen_at") < since)
    out = found.groupBy("slug").agg(F.count_if(now).alias("n"), F.count_if(before).alias("before"), F.count_distinct(F.when(now & ~F.col("is_syndicated"), F.col("media_id"))).alias("media"))
    return out.where("n > 0").orderBy(F.desc("n"), "slug").limit(top)


def daily_matrix(articles: DataFrame, media: DataFrame, since: Column, until: Column, tz: str = "UTC") -> DataFrame:
    """media_id, day, own, syndicated: every day of the period for every outlet, days without articles too."""
    last = F.date_sub(time.local_day(until, tz), F.when(time.to_local(until, tz) == time.local_day(until, tz).cast("timestamp_ntz"), 1).otherwise(0))
    grid = media.select("media_id", F.explode(F.sequence(time.local_day(since, tz), last)).alias("day"))
    counted = articles.where((F.col("first_seen_at") >= since) & (F.col("first_seen_at") < until)).groupBy("media_id", time.local_day(F.col("first_seen_at"), tz).alias("day"))
    counted = counted.agg(F.count_if(~F.col("is_syndicated")).alias("own"), F.count_if("is_syndicated").alias("syndicated"))
    return grid.join(counted, ["media_id", "day"], "left").fillna(0, ["own", "syndicated"])


def agenda(articles: DataFrame, members: DataFrame, tz: str = "UTC") -> DataFrame:
    """Shared agenda of each pair of outlets.  A story is an article's open group, or the article alone.  Only weeks in
    which both outlets have stories count.  Returns media_a, media_b, shared, all_stories, stories_a, stories_b,
    universe, jaccard, containment_a, containment_b, expected, lift.

    articles: id, media_id, first_seen_at, is_syndicated; members: id, group_id."""
    one = members.groupBy("id").agg(F.max("group_id").alias("group_id"))
    story = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("a"), F.col("id").cast("string")))
    s = kept(articles.where("not is_syndicated").join(one, "id", "left").select(time.week_start(F.col("first_seen_at"), tz).alias("week"), "media_id", story.alias("story")).distinct())
    present = s.select("week", "media_id").distinct()
    grid = present.select("week", F.col("media_id").alias("media_a")).join(present.select("week", F.col("media_id").alias("media_b")), "week").where("media_a < media_b")
    weeks = grid.groupBy("media_a", "media_b").agg(F.array_sort(F.collect_set("week")).alias("weeks"))
    # Stories of an outlet, and of any, in a set of weeks: pairs with the same weeks share one count.
    sides = weeks.select(F.explode(F.array("media_a", "media_b")).alias("media_id"), "weeks").distinct().withColumn("week", F.explode("weeks"))
    each = sides.join(s, ["week", "media_id"]).groupBy("media_id", "weeks").agg(F.count_distinct("story").alias("stories"))
    kinds = weeks.select("weeks").distinct().withColumn("week", F.explode("weeks"))
    universe = kinds.join(s.select("week", "story").distinct(), "week").groupBy("weeks").agg(F.count_distinct("story").alias("universe"))
    # Stories that both have come from the pairs inside each story.
    inside = s.groupBy("story", "media_id").agg(F.collect_set("week").alias("in"))
    both = inside.select("story", F.col("media_id").alias("media_a"), F.col("in").alias("in_a")).join(inside.select("story", F.col("media_id").alias("media_b"), F.col("in").alias("in_b")), "story").where("media_a < media_b")
    common = both.join(weeks, ["media_a", "media_b"]).where(F.arrays_overlap("in_a", "weeks") & F.arrays_overlap("in_b", "weeks")).groupBy("media_a", "media_b").agg(F.count("*").alias("shared"))
    side = lambda x: each.select(F.col("media_id").alias(f"media_{x}"), "weeks", F.col("stories").alias(f"stories_{x}"))
    out = weeks.join(side("a"), ["media_a", "weeks"]).join(side("b"), ["media_b", "weeks"]).join(universe, "weeks").join(common, ["media_a", "media_b"], "left")
    out = out.withColumn("shared", F.coalesce("shared", F.lit(0).cast("long"))).withColumn("all_stories", F.col("stories_a") + F.col("stories_b") - F.col("shared")).drop("weeks")
    expected = F.col("stories_a") * F.col("stories_b") / F.col("universe")
    return out.select(
        "media_a", "media_b", "shared", "all_stories", "stories_a", "stories_b", "universe", (F.col("shared") / F.col("all_stories")).alias("jaccard"), (F.col("shared") / F.col("stories_a")).alias("containment_a"), (F.col("shared") / F.col("stories_b")).alias("containment_b"),
        expected.alias("expected"), (F.col("shared") / expected).alias("lift"),
    )


def exclusive_coverage(articles: DataFrame, members: DataFrame) -> DataFrame:
    """media_id, notes, shared (in a group with other outlets), alone."""
    own = articles.where("not is_syndicated")
    one = members.groupBy("id").agg(F.max("group_id").alias("group_id"))
    wide = own.join(one, "id").groupBy("group_id").agg(F.count_distinct("media_id").alias("outlets")).where("outlets > 1")
    marked = own.join(one, "id", "left").join(wide, "group_id", "left")
    return marked.groupBy("media_id").agg(F.count("*").alias("notes"), F.count_if(F.col("outlets") > 1).alias("shared")).withColumn("alone", F.col("notes") - F.col("shared"))


def sequences(members: DataFrame) -> DataFrame:
    """Who was first, for each pair of outlets in common groups, by publication (ties under a minute) and by detection.
    members: group_id, media_id, published_at (null without an hour), first_seen_at, is_syndicated."""
    rep = members.where("not is_syndicated").groupBy("group_id", "media_id").agg(F.min("published_at").alias("pub"), F.min("first_seen_at").alias("det"))
    a = rep.select("group_id", F.col("media_id").alias("media_a"), F.col("pub").alias("pa"), F.col("det").alias("da"))
    b = rep.select("group_id", F.col("media_id").alias("media_b"), F.col("pub").alias("pb"), F.col("det").alias("db"))
    both = a.join(b, "group_id").where("media_a < media_b")
    gap = (time.seconds(F.col("pb")) - time.seconds(F.col("pa"))) / 60.0
    g = both.withColumn("gap", F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), gap))
    out = g.groupBy("media_a", "media_b").agg(
        F.count("*").alias("groups"), F.count_if(F.col("gap") >= 1).alias("pub_a_first"), F.count_if(F.col("gap") <= -1).alias("pub_b_first"), F.count_if(F.abs("gap") < 1).alias("pub_tie"), F.count_if(F.col("gap").isNull()).alias("pub_unknown"),
        F.count_if(F.col("da") < F.col("db")).alias("det_a_first"), F.count_if(F.col("da") > F.col("db")).alias("det_b_first"), F.count_if(F.col("da") == F.col("db")).alias("det_tie"),
        F.median("gap").alias("median_signed"), F.median(F.abs("gap")).alias("median_gap"),
    )
    share = stats.wilson(F.col("pub_a_first"), F.col("pub_a_first") + F.col("pub_b_first"))
    # Exclusive quartiles from running counts of the distinct gaps: the value at place k, and a share of the step to the next.
    pair = ["media_a", "media_b"]
    counts = g.where("gap is not null").groupBy(*pair, F.abs("gap").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*pair)
    ranked = counts.withColumns({"upto": F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})

    def quartile(p: float) -> Column:
        place = p * (F.col("all") + 1)
        k = F.greatest(F.lit(1), F.least(F.floor(place), F.col("all") - 1))
        at = lambda i: F.max(F.when((F.col("upto") - F.col("n") < i) & (i <= F.col("upto")), F.col("value")))
        return F.when(F.max("all") >= 4, at(k) + (at(k + 1) - at(k)) * F.max(place - k))

    out = out.join(ranked.groupBy(*pair).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3")), pair, "left")
    return out.withColumns({"share_lo": share["lo"], "share_hi": share["hi"]})


WINDOW_HOURS, BASELINE_DAYS, MIN_COUNT, MAD_FACTOR, MAD_SCALE, MIN_SPREAD, MIN_DAYS, MIN_COVERAGE = 3, 14, 4, 3.0, 1.4826, 1.0, 7, 0.5


def rising_topics(hits: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """Topics far above their usual count.  Windows of three hours count back from ``now``; the usual count is the
    median over the same slot of earlier days, in windows with at least half of the slot's usual volume.

    hits: slug, id; articles: id, media_id, published_at, is_syndicated.
    Returns slug, n, usual, threshold, media."""
    per_day = 24 // WINDOW_HOURS
    ago = time.seconds(now) - time.seconds(F.col("published_at"))
    a = articles.where(F.col("published_at").isNotNull() & (ago >= -3600)).withColumn("win", F.floor(F.greatest(ago, F.lit(0)) / (WINDOW_HOURS * 3600)).cast("int")).where(F.col("win") <= BASELINE_DAYS * per_day)
    totals = a.groupBy("win").agg(F.count("*").alias("n"))
    usual = totals.where("win > 0").groupBy((F.col("win") % per_day).alias("slot")).agg(F.median("n").alias("usual"))
    active = totals.join(usual, F.col("win") % per_day == F.col("slot"), "left").where(F.col("n") >= MIN_COVERAGE * F.coalesce("usual", F.lit(0.0))).select("win")
    state = active.agg(F.count_if(F.col("win") == 0).alias("fresh"), F.count_if(F.col("win") > 0).alias("base"))
    base = active.where((F.col("win") > 0) & (F.col("win") % per_day == 0))
    own = kept(hits.join(a.where("not is_syndicated"), "id").groupBy("slug", "win").agg(F.count("*").alias("n"), F.collect_set("media_id").alias("outlets")))
    grid = own.select("slug").distinct().crossJoin(F.broadcast(base))  # at most BASELINE_DAYS windows
    usual_n = grid.join(own.select("slug", "win", "n"), ["slug", "win"], "left").fillna(0, ["n"]).groupBy("slug").agg(F.collect_list(F.col("n").cast("double")).alias("ns"))
    level = usual_n.where(F.size("ns") >= MIN_DAYS).withColumn("usual", stats.median_of(F.col("ns"))).withColumn("mad", stats.mad(F.col("ns"), F.col("usual")))
    level = level.withColumn("threshold", F.col("usual") + MAD_FACTOR * F.greatest(MAD_SCALE * F.col("mad"), F.lit(MIN_SPREAD)))
    current = own.where("win = 0").select("slug", "n", F.size("outlets").alias("media"))
    ok = (F.col("n") >= MIN_COUNT) & (F.col("n") > F.col("threshold")) & (F.col("fresh") == 1) & (F.col("base") * WINDOW_HOURS >= MIN_DAYS * 24)
    return current.join(level, "slug").crossJoin(F.broadcast(state)).where(ok).select("slug", "n", F.bround("usual", 1).alias("usual"), F.bround("threshold", 1).alias("threshold"), "media")


def _exposures(events: DataFrame, tz: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(first impressions with their rank, acted) by article, reader and local day."""
    key = ["article_id", "user_id", "day"]
    dated = events.withColumn("day", time.local_day(F.col("created_at"), tz))
    at = F.when(F.col("rank").isNotNull(), F.struct("created_at", "id"))
    shown = dated.where(F.col("event") == "impresion").groupBy(*key).agg(F.min_by("rank", at).alias("rank"))
    acted = dated.where(F.col("event").isin("detalle", "original")).select(*key).distinct().withColumn("acted", F.lit(1))
    return shown, acted, key


def interest_funnel(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Readers' actions by the rank of an article's first impression of the day (1-5, 6-15, 16 to 10,000): articles shown,
    those with an action that day, share and its interval.  Impressions without a rank are in no bucket.
    events: article_id, user_id, event, rank, created_at, id."""
    shown, acted, key = _exposures(events, tz)
    bucket = F.when(F.col("rank") <= 5, "1-5").when(F.col("rank") <= 15, "6-15").otherwise("16+")
    both = shown.where(F.col("rank").between(1, 10_000)).join(acted, key, "left")
    out = both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("shown"), F.count("acted").alias("acted"))
    w = stats.wilson(F.col("acted"), F.col("shown"))
    return out.select("bucket", "shown", "acted", (F.col("acted") / F.col("shown")).alias("share"), w["lo"].alias("lo"), w["hi"].alias("hi"))


def interest_totals(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row: articles shown and acted on by reader and day, those that were both, and their share of the shown ones with
    its interval (null if nothing was shown).  A repeated event counts once."""
    shown, acted, key = _exposures(events, tz)
    both = shown.withColumn("shown", F.lit(1)).join(acted, key, "full")
    out = both.agg(F.count("shown").alias("impressions"), F.count("acted").alias("actions"), F.count(F.col("shown") + F.col("acted")).alias("exposed_actions"))
    w = stats.wilson(F.col("exposed_actions"), F.col("impressions"))
    return out.select("*", F.when(F.col("impressions") > 0, F.col("exposed_actions") / F.col("impressions")).alias("share"), w["lo"].alias("lo"), w["hi"].alias("hi"))


def daily_rollup(runs: DataFrame, tz: str = "UTC") -> DataFrame:
    """day, run_type, scope, runs, ok, items, last_run_id.  Runs count once, however often they are given."""
    once = runs.dropDuplicates(["id"])
    return once.groupBy(time.local_day(F.col("started_at"), tz).alias("day"), "run_type", "scope").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("items").alias("items"), F.max("id").alias("last_run_id"))


def extend_rollup(rollup: DataFrame, runs: DataFrame, tz: str = "UTC") -> DataFrame:
    """The rollup with new runs; a run up to a row's last_run_id was counted before and changes nothing."""
    keyed = runs.withColumn("day", time.local_day(F.col("started_at"), tz)).join(rollup.select("day", "run_type", "scope", "last_run_id"), ["day", "run_type", "scope"], "left")
    fresh = daily_rollup(keyed.where(F.col("last_run_id").isNull() | (F.col("id") > F.col("last_run_id"))).drop("day", "last_run_id"), tz)
    return rollup.unionByName(fresh).groupBy("day", "run_type", "scope").agg(F.sum("runs").alias("runs"), F.sum("ok").alias("ok"), F.sum("items").alias("items"), F.max("last_run_id").alias("last_run_id"))


def coverage(rollup: DataFrame, period_days: int) -> DataFrame:
    """scope, runs, ok, items, observed days, success rate, share of the period's days."""
    out = rollup.groupBy("scope").agg(F.sum("runs").alias("runs"), F.sum("ok").alias("ok"), F.sum("items").alias("items"), F.count_distinct("day").alias("days"))
    return out.select("*", (F.col("ok") / F.col("runs")).alias("success"), (F.col("days") / period_days).alias("observed"))


def hourly_histogram(articles: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """hours_ago, n for each of the last ``hours`` hours, empty ones too."""
    ago = F.floor((time.seconds(now) - time.seconds(F.col("first_seen_at"))) / 3600).cast("int")
    counted = articles.withColumn("hours_ago", ago).where(F.col("hours_ago").between(0, hours - 1)).groupBy("hours_ago").agg(F.count("*").alias("n"))
    grid = articles.sparkSession.range(hours).select(F.col("id").cast("int").alias("hours_ago"))
    return grid.join(counted, "hours_ago", "left").fillna(0, ["n"])


def recent_failures(events: DataFrame, minutes: int) -> DataFrame:
    """Each event with the number of events of its key in the ``minutes`` up to it, times to the nearest second (halves to
    the even one).  events: key, at, id."""
    at = F.rint(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at").cast("timestamp_ntz")) / 1e6).cast("long")
    w = Window.partitionBy("key").orderBy("s").rangeBetween(-60 * minutes, 0)
    return events.withColumn("s", at).withColumn("n", F.count("*").over(w)).drop("s")


def group_ranking(members: DataFrame, since: Column, until: Column, top: int = 20) -> DataFrame:
    """Groups by independent outlets, then articles, then the earliest; only members in the period count."""
    inside = members.where((F.col("first_seen_at") >= since) & (F.col("first_seen_at") < until))
    out = inside.groupBy("group_id").agg(F.count_distinct(F.when(~F.col("is_syndicated"), F.col("media_id"))).alias("independent"), F.count("*").alias("notes"), F.min("first_seen_at").alias("first_seen"))
    return out.orderBy(F.desc("independent"), F.desc("notes"), "first_seen", "group_id").limit(top)


def chronology(members: DataFrame) -> DataFrame:
    """group_id, first_detected and first_published (outlets; ties: smaller id), timed, total."""
    first = lambda c: F.min_by("media_id", F.when(F.col(c).isNotNull(), F.struct(c, "media_id")))
    return members.groupBy("group_id").agg(first("first_seen_at").alias("first_detected"), first("published_at").alias("first_published"), F.count("published_at").alias("timed"), F.count("*").alias("total"))


def coverage_level(articles: DataFrame) -> DataFrame:
    """media_id, notes, with_body, with_subtitle, level: cuerpo where half have a body, bajada where half have a
    subtitle, else titular."""
    out = articles.groupBy("media_id").agg(F.count("*").alias("notes"), F.count_if(F.coalesce(F.length("body") > 0, F.lit(False))).alias("with_body"), F.count_if(F.coalesce(F.length("subtitle") > 0, F.lit(False))).alias("with_subtitle"))
    level = F.when(2 * F.col("with_body") >= F.col("notes"), "cuerpo").when(2 * F.col("with_subtitle") >= F.col("notes"), "bajada").otherwise("titular")
    return out.withColumn("level", level)


def source_states(subsources: DataFrame, now: Column, stale_hours: int = 6) -> DataFrame:
    """media_id, state, sources, last_success: the outlet's state from its sources' states."""
    age = (time.seconds(now) - time.seconds(F.col("last_success_at"))) / 3600
    state = F.when(~F.col("enabled"), "pausada").when(F.col("last_success_at").isNull(), "sin_datos").when(F.col("failures") >= 3, "error").when(age > stale_hours, "demorada").otherwise("ok")
    s = subsources.withColumn("state", state)
    out = s.groupBy("media_id").agg(
        F.count("*").alias("sources"), F.count_if(F.col("state") == "ok").alias("ok"), F.bool_and(F.col("state") == "pausada").alias("paused"), F.bool_or(F.col("state").isin("error", "demorada")).alias("trouble"), F.max("last_success_at").alias("last_success")
    )
    whole = F.when(F.col("paused"), "pausado").when((F.col("ok") > 0) & ~F.col("trouble"), "ok").when(F.col("ok") > 0, "parcial").when(F.col("trouble"), "con_problemas").otherwise("sin_datos")
    return out.select("media_id", whole.alias("state"), "sources", "last_success")


def tone(results: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, media_id, favorable, critico, neutral, incierto, opposed from the latest valid result of each group.
    results: group_id, id, valid, result (JSON with ``enfoque`` and ``tono_por_nota`` by letter), article_ids."""
    shape = "enfoque string, tono_por_nota array<struct<articulo: string, sujeto: string, valoracion: string, fragmento: string>>"
    last = results.where("valid").groupBy("group_id").agg(F.max_by(F.struct("result", "article_ids"), "id").alias("x"))
    parsed = last.select("group_id", F.from_json("x.result", shape).alias("r"), F.col("x.article_ids").alias("article_ids"))
    rows = parsed.select("group_id", "article_ids", F.col("r.enfoque").alias("focus"), F.explode("r.tono_por_nota").alias("t"))
    rows = rows.select("group_id", "focus", F.get("article_ids", F.ascii("t.articulo") - 65).alias("id"), F.col("t.valoracion").alias("value")).join(members.select("id", "media_id"), "id")
    values = ["favorable", "critico", "neutral", "incierto"]
    both = Window.partitionBy("group_id")
    opposed = (F.col("focus") == "opuesto") | (F.max((F.col("value") == "favorable").cast("int")).over(both) + F.max((F.col("value") == "critico").cast("int")).over(both) == 2)
    return rows.withColumn("opposed", F.coalesce(opposed, F.lit(False))).groupBy("group_id", "media_id").agg(*(F.count_if(F.col("value") == v).alias(v) for v in values), F.bool_or("opposed").alias("opposed"))


def entity_report(articles: DataFrame, entity: str, least: int = 2, top: int = 20) -> dict[str, DataFrame]:
    """Articles that name an entity: by outlet, by day, and the names beside it.  articles: id, media_id, title,
    subtitle, first_seen_at, ents."""
    from ..functions.text import norm

    name = norm(F.lit(entity))
    mine = articles.where(has_term(search_tokens(F.concat_ws(" ", "title", "subtitle")), F.lit(entity)))
    beside = mine.select(F.explode("ents").alias("name")).where(F.col("name") != name).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(top)
    return {"media": mine.groupBy("media_id").agg(F.count("*").alias("n")), "days": mine.groupBy(time.local_day(F.col("first_seen_at")).alias("day")).agg(F.count("*").alias("n")), "names": beside}


def repeated(rows: DataFrame, key: str, id_: str = "id", least: int = 2) -> DataFrame:
    """Values of ``key`` that ``least`` rows or more have: key, n, first_id.  Null is no value."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).where(F.col("n") >= least)


def usage(calls: DataFrame, tz: str = "UTC") -> DataFrame:
    """model, day (local), calls, tokens, cost; without any token or cost known the sums are 0.
    calls: model, at, tokens, cost."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy("model", time.local_day(F.col("at"), tz).alias("day")).agg(F.count("*").alias("calls"), zero("tokens"), zero("cost"))


def account_counts(posts: DataFrame) -> DataFrame:
    """account_id, posts, own, last, with_links.  posts: account_id, is_own, at, links (array)."""
    return posts.groupBy("account_id").agg(F.count("*").alias("posts"), F.count_if(F.coalesce("is_own", F.lit(False))).alias("own"), F.max("at").alias("last"), F.count_if(F.size(F.coalesce("links", F.array().cast("array<string>"))) > 0).alias("with_links"))


def frequent_sections(articles: DataFrame, top: int = 40) -> DataFrame:
    """media_id, section, n, place: the ``top`` sections that each outlet has most of (ties: by name)."""
    n = articles.where("section is not null").groupBy("media_id", "section").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("n"), "section"))).where(F.col("place") <= top)


def freshness(items: DataFrame, now: Column, stale_hours: float = 6) -> DataFrame:
    """scope, last_at, hours since then, state (vieja beyond ``stale_hours``), last_day (items of the last 24 hours).
    items: scope, at."""
    out = items.groupBy("scope").agg(F.max("at").alias("last_at"), F.count_if(time.seconds(F.col("at")) >= time.seconds(now) - 86400).alias("last_day"))
    hours = (time.seconds(now) - time.seconds(F.col("last_at"))) / 3600
    return out.select("scope", "last_at", hours.alias("hours"), F.when(hours > stale_hours, "vieja").otherwise("fresca").alias("state"), "last_day")


def due(sources: DataFrame, now: Column) -> DataFrame:
    """The enabled sources that were never fetched, or whose interval is over.  sources: id, enabled, last_fetch_at,
    min_interval_seconds, and others, which stay."""
    over = time.seconds(F.col("last_fetch_at")) + F.col("min_interval_seconds") <= time.seconds(now)
    return sources.where(F.col("enabled") & F.coalesce(over, F.lit(True)))


def in_turn(sources: DataFrame) -> DataFrame:
    """The sources with their ``place``: those never fetched first, then the longest ago (ties: by id).  Ranges of the order
    are numbered by themselves, after the sizes of the ranges before.  sources: id, last_fetch_at and others."""
    order = [F.asc_nulls_first("last_fetch_at"), F.asc("id")]
    ranged = kept(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("own", place).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("own")).drop("range", "own", "before")
