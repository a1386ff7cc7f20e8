"""Idempotent merges: articles, sightings, posts, relations, alerts; retention; CSV and snapshot sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import EVENTS
from ..functions.text import content_hash, own_words, search_text, title_similarity
from ..functions.time import local_day

MIN_TITLE = 0.3
NEW_ACCOUNTS, ALL_ACCOUNTS = 100, 300
WAITS, TRIES = [1, 5, 15, 60], 5
POST = ["url", "text", "preview_title", "preview_text", "links", "posted_at", "is_repost", "forwarded_from"]


def upsert_articles(current: DataFrame, items: DataFrame) -> DataFrame:
    """The articles after a batch of feed items, with ``outcome`` (new, updated, seen, kept).

    An item without an http url or a title is skipped.  It belongs to the article with its outlet and canonical url,
    or else with its outlet and source id if the titles are similar enough.  Missing fields erase nothing, a
    body replaces, syndication sticks, a date fills only an unknown one.  Running a batch twice changes nothing.

    Both: media_id, canonical_url, source_id, title, subtitle, author, section, body, is_syndicated, published_at,
    published_precision, first_seen_at."""
    ok = items.where(F.col("canonical_url").rlike("^https?://") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    last = Window.partitionBy("media_id", "canonical_url").orderBy(F.desc("first_seen_at"), F.desc("title"))
    newest = ok.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")
    earliest = ok.groupBy("media_id", "canonical_url").agg(F.min("first_seen_at").alias("earliest"))
    newest = newest.join(earliest, ["media_id", "canonical_url"])
    ids = current.where("source_id is not null").select("media_id", "source_id", F.col("canonical_url").alias("old_url"), F.col("title").alias("old_title"))
    by_id = newest.join(ids, ["media_id", "source_id"], "left")
    known = current.select("media_id", "canonical_url").withColumn("known", F.lit(True))
    by_id = by_id.join(known, ["media_id", "canonical_url"], "left")
    similar = title_similarity(F.col("title"), F.col("old_title")) >= MIN_TITLE
    same = F.col("known").isNull() & F.col("old_url").isNotNull() & similar
    taken = F.col("known").isNull() & F.col("old_url").isNotNull() & ~similar
    keyed = by_id.withColumn("source_id", F.when(~F.coalesce(taken, F.lit(False)), F.col("source_id"))).withColumn("key_url", F.when(same, F.col("old_url")).otherwise(F.col("canonical_url")))
    one = Window.partitionBy("media_id", "key_url").orderBy(F.desc("first_seen_at"), F.desc("title"), "canonical_url")
    keyed = keyed.withColumn("place", F.row_number().over(one)).where("place = 1").drop("place", "known", "old_url", "old_title")
    o, n = current.alias("o"), keyed.alias("n")
    both = o.join(n, (F.col("o.media_id") == F.col("n.media_id")) & (F.col("o.canonical_url") == F.col("n.key_url")), "full")
    fill = lambda c: F.coalesce(F.when(F.length(F.col(f"n.{c}")) > 0, F.col(f"n.{c}")), F.col(f"o.{c}"))
    dated = F.coalesce(F.col("o.published_precision"), F.lit("none")) != "none"
    changed = content_hash(F.col("o.title"), F.col("o.subtitle")) != content_hash(fill("title"), fill("subtitle"))
    outcome = F.when(F.col("o.media_id").isNull(), "new").when(F.col("n.media_id").isNull(), "kept").when(changed, "updated").otherwise("seen")
    return both.select(
        F.coalesce("o.media_id", "n.media_id").alias("media_id"), F.coalesce("o.canonical_url", "n.key_url").alias("canonical_url"), F.coalesce("o.source_id", "n.source_id").alias("source_id"),
        *(fill(c).alias(c) for c in ("title", "subtitle", "author", "section", "body")), (F.coalesce("o.is_syndicated", F.lit(False)) | F.coalesce("n.is_syndicated", F.lit(False))).alias("is_syndicated"),
        F.when(dated, F.col("o.published_at")).otherwise(F.col("n.published_at")).alias("published_at"), F.when(dated, F.col("o.published_precision")).otherwise(F.coalesce("n.published_precision", F.lit("none"))).alias("published_precision"),
        F.coalesce("o.first_seen_at", "n.earliest").alias("first_seen_at"), outcome.alias("outcome"),
    )


def new_versions(current: DataFrame, merged: DataFrame) -> DataFrame:
    """A headline version for each article that is new or whose title or subtitle changed."""
    return merged.where(F.col("outcome").isin("new", "updated")).select("media_id", "canonical_url", "title", "subtitle", content_hash(F.col("title"), F.col("subtitle")).alias("hash"))


def sightings(observed: DataFrame) -> DataFrame:
    """article_id, subsource_id, first_seen, last_seen, times_seen, item_url (of the last)."""
    return observed.groupBy("article_id", "subsource_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("times_seen"), F.max_by("item_url", F.struct("at", "item_url")).alias("item_url"))


def insert_absent(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not there yet, one each."""
    return rows.dropDuplicates(key).join(current.select(*key), key, "left_anti")


def enrich(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles with missing fields filled from their pages.  pages: id, description, authors, section, published_at."""
    p = pages.select("id", F.col("description").alias("p_sub"), F.array_join("authors", ", ").alias("p_author"), F.col("section").alias("p_section"), F.col("published_at").alias("p_at"))
    both = articles.join(p, "id", "left")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    undated = F.coalesce("published_precision", F.lit("none")) == "none"
    return both.withColumns({
        "subtitle": F.when(empty("subtitle"), F.col("p_sub")).otherwise(F.col("subtitle")), "author": F.when(empty("author"), F.col("p_author")).otherwise(F.col("author")), "section": F.when(empty("section"), F.col("p_section")).otherwise(F.col("section")),
        "published_at": F.when(undated, F.col("p_at")).otherwise(F.col("published_at")), "published_precision": F.when(undated & F.col("p_at").isNotNull(), "datetime").otherwise(F.col("published_precision")),
    }).drop("p_sub", "p_author", "p_section", "p_at")


def admitted_posts(posts: DataFrame, accounts: DataFrame, now: Column, retention_days: int | None = None, new: int = NEW_ACCOUNTS, most: int = ALL_ACCOUNTS) -> tuple[DataFrame, DataFrame]:
    """(posts, new accounts) of an import: posts that retention would delete at once stay out; authors that are not known
    yet become accounts in the order in which they come (``place``), at most ``new`` in an import and ``most`` in all, and
    the other authors' posts stay out.

    posts: handle, place, posted_at and more; accounts: handle.  Handles are compared in lower case; a post without a
    handle or date stays out.  The account takes the spelling of its first post."""
    dated = posts.where(F.col("handle").isNotNull() & F.col("posted_at").isNotNull()).withColumn("handle_key", F.lower("handle"))
    if retention_days:
        dated = dated.where(F.col("posted_at") >= now - F.make_dt_interval(F.lit(retention_days)))
    known = accounts.where("handle is not null").select(F.lower("handle").alias("handle_key")).distinct()
    room = max(0, min(new, most - known.count()))
    first = dated.join(known, "handle_key", "left_anti").groupBy("handle_key").agg(F.min(F.struct("place", "handle")).alias("first"))
    opened = first.orderBy("first").limit(room).select("handle_key", F.col("first.handle").alias("handle"))
    return dated.join(known.unionByName(opened.select("handle_key")), "handle_key", "left_semi"), opened


def upsert_posts(current: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """The posts after a batch, with ``outcome`` (new, updated, seen, kept).  A post is known by account and its id there.
    Views are renewed where the batch has them; an edited text replaces the old one with its links and preview and sets
    ``edited_at``, no version is kept.  Running a batch twice changes no text.

    Both: account_id, external_id, url, text, preview_title, preview_text, links, posted_at, is_repost, forwarded_from,
    views; posts: edited; current: search_text, hash, first_seen_at, last_seen_at, edited_at.  A batch's repeated post counts
    once, as its latest by date, views and text; rows without account or id are left out."""
    key = ["account_id", "external_id"]
    latest = F.max(F.struct("posted_at", F.coalesce("views", F.lit(-1)).alias("seen_by"), F.coalesce("text", F.lit("")).alias("words"), F.struct("views", "edited", *POST).alias("post")))
    batch = posts.where("account_id is not null and external_id is not null").groupBy(*key).agg(latest.alias("x")).select(*key, "x.post.*")
    said = own_words(F.col("text"), F.concat_ws(" ", F.nullif("preview_title", F.lit("")), F.nullif("preview_text", F.lit(""))))
    batch = batch.withColumn("said", said).withColumns({"search_text": search_text(F.col("said")), "hash": content_hash(F.col("said"), F.col("text"))}).drop("said")
    n, o = batch.withColumn("found", F.lit(True)).alias("n"), current.withColumn("held", F.lit(True)).alias("o")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    old, found = F.col("held").isNotNull(), F.col("found").isNotNull()
    edited = old & found & ~F.col("o.hash").eqNullSafe(F.col("n.hash"))
    fresh = ~old | edited
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    fixed = lambda c: F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(
        *(fixed(k) for k in key), *(fixed(c) if c in ("url", "posted_at", "is_repost", "forwarded_from") else pick(c) for c in POST), F.coalesce("n.views", "o.views").alias("views"), pick("search_text"), pick("hash"),
        F.when(old, F.col("o.first_seen_at")).otherwise(now).alias("first_seen_at"), F.when(found, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(edited | (~old & F.coalesce("n.edited", F.lit(False))), now).otherwise(F.col("o.edited_at")).alias("edited_at"),
        F.when(~old, "new").when(edited, "updated").when(found, "seen").otherwise("kept").alias("outcome"),
    )


def record_interactions(current: DataFrame, events: DataFrame, tz: str = "UTC") -> DataFrame:
    """The events to add: the first of each article, reader, kind, local day and context (64 characters of it) that is
    not there yet.  events: article_id, user_id, event, context, rank, created_at; current: the first five keys with ``day``.
    Kinds that are not recorded, and rows without a reader or article, are left out; a null context is the empty one.
    Ties in time go to the smallest rank, none last."""
    key = ["article_id", "user_id", "event", "day", "context"]
    known = events.where(F.col("event").isin(*EVENTS) & F.col("user_id").isNotNull() & F.col("article_id").isNotNull())
    known = known.withColumns({"context": F.substring(F.coalesce("context", F.lit("")), 1, 64), "day": local_day(F.col("created_at"), tz)})
    earliest = F.struct("created_at", F.col("rank").isNull().alias("unranked"), "rank")
    first = known.groupBy(*key).agg(F.min(earliest).alias("x")).select(*key, "x.rank", "x.created_at")
    return first.join(current.select(*key).distinct(), key, "left_anti")


def merge_relations(old: DataFrame, new: DataFrame, loaded: DataFrame) -> DataFrame:
    """Stored relations after an analysis: reviewed rows stay as they are, pending ones take the new values, pending
    ones that were not found again go if both ends were loaded, new ones come in as pending.
    old: a, b, relation_type, score, review_status; new: without status; loaded: id."""
    o, n = old.alias("o"), new.alias("n")
    key = ["a", "b", "relation_type"]
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    merged = both.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key), F.col("o.score").alias("old"), F.col("n.score").alias("new"), F.coalesce("o.review_status", F.lit("pendiente")).alias("review_status"), F.col("n.a").isNotNull().alias("found"))
    ends = loaded.select(F.col("id").alias("a")).withColumn("la", F.lit(True))
    merged = merged.join(ends, "a", "left").join(ends.withColumnRenamed("a", "b").withColumnRenamed("la", "lb"), "b", "left")
    stale = (F.col("review_status") == "pendiente") & ~F.col("found") & F.col("la").isNotNull() & F.col("lb").isNotNull()
    score = F.when((F.col("review_status") == "pendiente") & F.col("found"), F.col("new")).otherwise(F.col("old"))
    return merged.where(~stale).select(*key, score.alias("score"), "review_status")


def evaluate_alerts(members: DataFrame, relations: DataFrame, least: int = 2, excluded_sections: list[str] | None = None) -> DataFrame:
    """group_id, independent, notes, priority, fingerprint of the groups that reach ``least`` independent outlets.
    members: group_id, id, media_id, is_syndicated, section; relations: group_id, relation_type, score."""
    rank = F.when(F.col("relation_type").isin("titular_identico", "referencia_explicita"), 3).when(F.col("relation_type").isin("titular_casi_identico", "expresion_compartida"), 2).otherwise(1)
    pr = relations.groupBy("group_id").agg(F.max(rank).alias("priority"), F.max("score").alias("score"))
    out = members.groupBy("group_id").agg(
        F.count_distinct(F.when(~F.col("is_syndicated"), F.col("media_id"))).alias("independent"), F.count("*").alias("notes"), F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("media_id")).alias("media_ids"),
        F.bool_and(F.coalesce(F.col("section").isin(*(excluded_sections or [""])), F.lit(False))).alias("excluded"),
    )
    out = out.join(pr, "group_id", "left").where((F.col("independent") >= least) & ~F.col("excluded"))
    print_ = F.sha2(F.to_json(F.struct("ids", "media_ids", F.coalesce("priority", F.lit(0)).alias("priority"))), 256)
    return out.select("group_id", "independent", "notes", F.coalesce("priority", F.lit(0)).alias("priority"), "media_ids", print_.alias("fingerprint"))


def update_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One alert a group: created, unchanged (same fingerprint), updated (outlets or priority differ), refreshed (other
    differences), or closed where the group is no longer there.  old: group_id, fingerprint, priority, media_ids, version."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.group_id") == F.col("n.group_id"), "full")
    material = (F.size(F.array_except("n.media_ids", "o.media_ids")) > 0) | (F.col("n.priority") > F.col("o.priority"))
    state = F.when(F.col("o.group_id").isNull(), "created").when(F.col("n.group_id").isNull(), "closed").when(F.col("o.fingerprint") == F.col("n.fingerprint"), "unchanged").when(material, "updated").otherwise("refreshed")
    version = F.coalesce("o.version", F.lit(0)) + state.isin("created", "updated").cast("int")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return both.select(pick("group_id"), pick("fingerprint"), pick("priority"), pick("media_ids"), state.alias("state"), version.alias("version"))


def notifications(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """One message for each alert and version that was created or updated and not queued before."""
    due = alerts.where(F.col("state").isin("created", "updated")).select("group_id", "version", F.concat_ws(":", F.lit("alert"), F.col("group_id").cast("string"), F.col("version").cast("string")).alias("dedupe_key"))
    return insert_absent(sent, due, ["dedupe_key"])


def due_messages(queue: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The waiting messages whose time has come, the oldest ids first, ``limit`` at a time."""
    return queue.where((F.col("status") == "pendiente") & (F.col("next_attempt_at") <= now)).orderBy("id").limit(limit)


def after_attempts(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after a round of sending.  A message that went out is ``enviada``; one that failed waits longer each time
    (``WAITS`` minutes), and after ``TRIES`` tries it is in ``error``.  Messages that wait for nothing stay as they are.

    queue: id, status, attempts, next_attempt_at, sent_at, last_error; outcomes: id, error (null: it went out).  A message
    with several outcomes failed if none of them went out, and counts one try; null attempts are none."""
    once = outcomes.where("id is not null").groupBy("id").agg(F.bool_or(F.col("error").isNull()).alias("went"), F.max("error").alias("error"))
    both = queue.join(once, "id", "left")
    tried = (F.col("status") == "pendiente") & F.col("went").isNotNull()
    n = F.coalesce("attempts", F.lit(0)) + tried.cast("int")
    failed = tried & ~F.col("went")
    wait = F.get(F.array(*map(F.lit, WAITS)), F.least(n - 1, F.lit(len(WAITS) - 1)))
    again = now + F.make_dt_interval(F.lit(0), F.lit(0), wait)
    return both.select(
        *(c for c in queue.columns if c not in ("status", "attempts", "next_attempt_at", "sent_at", "last_error")), F.when(tried & F.col("went"), "enviada").when(failed & (n >= TRIES), "error").otherwise(F.col("status")).alias("status"), n.cast("int").alias("attempts"),
        F.when(failed & (n < TRIES), again).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"), F.when(tried & F.col("went"), now).otherwise(F.col("sent_at")).alias("sent_at"), F.when(failed, F.col("error")).when(~tried, F.col("last_error")).alias("last_error"),
    )


def retention(articles: DataFrame, protected: list[DataFrame], before: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): articles first seen before a date go, unless one of the protected sets (id) has them."""
    safe = protected[0].select("id")
    for p in protected[1:]:
        safe = safe.unionByName(p.select("id"))
    old = articles.where(F.col("first_seen_at") < before)
    gone = old.join(safe.distinct(), "id", "left_anti")
    return articles.join(gone.select("id"), "id", "left_anti"), gone


def csv_cells(df: DataFrame) -> DataFrame:
    """Every cell as text that a spreadsheet won't run: a quote before a leading = + - @ tab or return."""
    safe = lambda c: F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return df.select(*(safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("header", True).option("sep", ";").option("lineSep", "\r\n").csv(path)


def snapshot(df: DataFrame) -> DataFrame:
    """Rows as JSON, to keep a report as it was."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("data"))
