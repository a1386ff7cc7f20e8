"""Lists, orders, pages, targets, candidates, posts, events and common sources on hand-computed cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumewire.functions import text
from plumewire.operators import common_source, merges, metrics, selection

T0 = datetime(2026, 10, 14, 18)
ARTICLE = "id long, media_id string, is_demo boolean, hidden_at timestamp_ntz, section string, author string, first_seen_at timestamp_ntz, clicks long, search_text string"


def now(days=0):
    return F.lit((T0 + timedelta(days)).isoformat(sep=" ")).cast("timestamp_ntz")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([
        (1, "a", False, None, "s", "Ana", T0, 3, "el dolar sube"), (2, "a", True, None, "s", "Ana", T0, 3, "el dolar"), (3, "b", None, T0, "s", "", T0 - timedelta(hours=24), 0, "sube todo"),
        (4, None, None, None, None, None, None, None, None), (5, "b", False, None, "t", None, T0 - timedelta(days=8), 9, ""),
    ], ARTICLE)


def test_visible(articles):
    assert ids(selection.visible(articles)) == [1, 4, 5]
    assert ids(selection.visible(articles, demo=True)) == [1, 2, 4, 5]
    assert ids(selection.visible(articles, hidden=True)) == [3] and ids(selection.visible(articles, hidden=None)) == [1, 3, 4, 5]


@pytest.mark.parametrize(("filters", "want"), [
    ({}, [1, 2, 3, 4, 5]), ({"media": "b"}, [3, 5]), ({"section": "s"}, [1, 2, 3]), ({"signed": True}, [1, 2]), ({"signed": False}, [3, 4, 5]), ({"period": "24h"}, [1, 2, 3]), ({"period": "30d"}, [1, 2, 3, 5]), ({"period": "siempre"}, [1, 2, 3, 4, 5]),
    ({"least_clicks": 3}, [1, 2, 5]), ({"words": "Dólar  sube"}, [1]), ({"words": "  "}, [1, 2, 3, 4, 5]),
])
def test_filters(articles, filters, want):
    assert ids(selection.filtered(articles, now(), **filters)) == want


def test_filters_by_other_tables(spark, articles):
    related = spark.createDataFrame([(1, 5), (1, None), (7, 1)], "a long, b long")
    assert ids(selection.filtered(articles, related=related)) == [1, 5]
    assert ids(selection.filtered(articles, hits=spark.createDataFrame([(2,), (2,), (None,)], "id long"))) == [2]
    assert selection.filtered(articles.limit(0), now(), period="24h", words="x", related=related).count() == 0


def test_excluded_terms_are_whole_words(spark):
    titles = spark.createDataFrame([(1, "El Papa León"), (2, "Papas fritas"), (3, None), (4, "a.b"), (4, "Sube"), (5, "axb")], "group_id long, title string")
    groups = titles.select("group_id").distinct()
    assert ids(selection.without_terms(groups, titles, ["PAPA", " ", "a.b"]), "group_id") == [2, 3, 5]
    assert ids(selection.without_terms(groups, titles, ["", " "]), "group_id") == [1, 2, 3, 4, 5]
    assert text.term_pattern([]) is None


def test_orders_put_undated_last(spark):
    g = spark.createDataFrame([(1, T0, 2, 5, None), (2, None, 2, 9, T0), (3, T0 - timedelta(1), 3, 1, T0), (4, T0, 2, 5, T0)], "group_id long, first_seen_at timestamp_ntz, media long, articles long, updated_at timestamp_ntz")
    said = lambda name: [r.group_id for r in g.orderBy(*selection.group_order(name)).collect()]
    assert said("recientes") == [4, 1, 3, 2] and said("antiguos") == [3, 4, 1, 2] and said("medios") == [3, 4, 1, 2] and said("notas") == [2, 4, 1, 3] and said("actualizados") == [4, 3, 2, 1] and said("otro") == said("medios")
    a = spark.createDataFrame([(1, "baja", T0, None, 1, 1), (2, "alta", T0 - timedelta(1), None, 2, 3), (3, "otra", T0, T0 + timedelta(1), 3, 2), (4, "media", None, None, 4, 2)], "id long, priority string, created_at timestamp_ntz, last_material_change_at timestamp_ntz, articles long, media long")
    told = lambda *order: [r.id for r in a.orderBy(*selection.alert_order(*order)).collect()]
    assert told() == [2, 4, 1, 3] and told(None, "cerrada") == told("novedad") == [3, 1, 2, 4] and told("novedad_asc") == [2, 1, 3, 4] and told("notas") == [4, 3, 2, 1] and told("medios") == [2, 3, 4, 1]


def test_pages_have_places_in_the_whole_list(spark):
    rows = spark.range(25).withColumn("clicks", F.col("id") % 5)
    order = [F.desc("clicks"), F.desc("id")]
    whole = [r.id for r in rows.orderBy(*order).collect()]
    shown = selection.page(rows, order, 3, 10).collect()
    assert [(r.id, r["rank"]) for r in sorted(shown, key=lambda r: r["rank"])] == [(whole[i], i + 1) for i in range(20, 25)]
    assert selection.page(rows, order, 9, 10).count() == 0 and selection.page(rows, order, 0, 10).count() == 10
    seen = selection.impressions(selection.page(rows, order, 1, 2), 7, "noticias", now())
    stored = spark.createDataFrame([(whole[0], 7, "impresion", T0.date(), "noticias")], "article_id long, user_id long, event string, day date, context string")
    assert [(r.article_id, r["rank"]) for r in merges.record_interactions(stored, seen).collect()] == [(whole[1], 2)]


def test_events_count_once_a_day(spark):
    e = [
        (1, 7, "impresion", "x" * 70, 4, T0), (1, 7, "impresion", "x" * 64 + "y", 2, T0), (1, 7, "impresion", "x" * 64, None, T0 - timedelta(hours=1)), (1, 7, "impresion", "x", 5, T0), (1, 7, "detalle", None, None, T0 + timedelta(hours=8)),
        (1, 7, "detalle", "", 1, T0 + timedelta(hours=10)), (1, None, "detalle", "", 1, T0), (None, 7, "detalle", "", 1, T0), (1, 7, "otro", "", 1, T0), (2, 7, "ocultar", "z", None, T0),
    ]
    schema = "article_id long, user_id long, event string, context string, rank long, created_at timestamp_ntz"
    stored = spark.createDataFrame([(2, 7, "ocultar", T0.date(), "z")], "article_id long, user_id long, event string, day date, context string")
    events = spark.createDataFrame(e, schema)
    got = {(r.event, r.context, r.day.day): (r["rank"], r.created_at) for r in merges.record_interactions(stored, events).collect()}
    assert got == {("impresion", "x" * 64, 14): (None, T0 - timedelta(hours=1)), ("impresion", "x", 14): (5, T0), ("detalle", "", 15): (None, T0 + timedelta(hours=8))}
    local = {(r.event, r.day.day) for r in merges.record_interactions(stored, events, "America/Argentina/Buenos_Aires").collect()}
    assert ("detalle", 14) in local and ("detalle", 15) in local  # 02:00 and 04:00 UTC are two local days
    both = merges.record_interactions(stored, events).select(*stored.columns).unionByName(stored)
    assert merges.record_interactions(both, events).count() == 0


def test_funnel_is_by_day(spark):
    e = [(1, 7, "impresion", 3, T0, 1), (1, 7, "impresion", 9, T0 - timedelta(hours=1), 2), (1, 7, "detalle", None, T0, 3), (1, 7, "impresion", 2, T0 + timedelta(1), 4), (2, 7, "impresion", None, T0, 5), (2, 7, "original", None, T0, 6), (3, 7, "detalle", None, T0, 7), (4, 7, "impresion", 0, T0, 8), (5, 7, "impresion", 10_001, T0, 9)]
    events = spark.createDataFrame(e, "article_id long, user_id long, event string, rank long, created_at timestamp_ntz, id long")
    assert {r.bucket: (r.shown, r.acted) for r in metrics.interest_funnel(events).collect()} == {"6-15": (1, 1), "1-5": (1, 0)}
    t = metrics.interest_totals(events).first()
    assert (t.impressions, t.actions, t.exposed_actions, t.share) == (5, 3, 2, 0.4) and t.lo < 0.4 < t.hi
    none = metrics.interest_totals(events.limit(0)).first()
    assert (none.impressions, none.share, none.lo) == (0, None, None)


TARGET = "id long, media_id string, is_demo boolean, extraction_status string, enrich_attempts int, first_seen_at timestamp_ntz, subtitle string, section string"


def test_enrich_targets(spark):
    ok = ("m", False, "feed_only", 0, T0, None, None)
    change = lambda i, **k: (i, *({**dict(zip(["media_id", "is_demo", "extraction_status", "enrich_attempts", "first_seen_at", "subtitle", "section"], ok)), **k}.values()))
    data = [
        change(1), change(2), change(3, first_seen_at=T0 + timedelta(hours=1)), change(4, media_id="o", is_demo=True), change(5, media_id="o", extraction_status="ok"), change(6, media_id="o", enrich_attempts=3), change(7, media_id="o", first_seen_at=T0 - timedelta(hours=49)),
        change(8, media_id="o", subtitle="x"), change(9, media_id="p", subtitle="x", section="s"), change(10, media_id="q", subtitle="x"), change(11, media_id=None, enrich_attempts=None, is_demo=None),
    ]
    a = spark.createDataFrame(data, TARGET)
    hits = spark.createDataFrame([(10,), (10,), (99,)], "id long")
    assert [(r.id, r.place) for r in selection.enrich_targets(a, hits, now(), 2, ["s"]).orderBy("media_id", "place").collect()] == [(11, 1), (3, 1), (2, 2), (9, 1), (10, 1)]
    assert ids(selection.enrich_targets(a, hits, now(), 1)) == [3, 10, 11]


def test_analysis_candidates(spark):
    r = [(1, 2, "mismo_hecho", 0.5, "pendiente", T0, None), (3, 4, "mismo_hecho", 0.9, None, T0, None), (1, 4, "mismo_tema", 0.9, None, T0, None), (1, 3, "mismo_hecho", 0.8, "rechazada", T0, None), (2, 4, "afirmaciones_distintas", None, None, T0 - timedelta(days=9), T0), (2, 3, "mismo_hecho", 0.7, None, T0 - timedelta(days=9), None), (1, 9, "mismo_hecho", 0.95, None, T0, None)]
    rel = spark.createDataFrame(r, "a long, b long, relation_type string, score double, review_status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    art = spark.createDataFrame([(1, False), (2, None), (3, False), (4, False), (9, True)], "id long, is_demo boolean")
    mem = spark.createDataFrame([(10, 1, True), (10, 2, True), (11, 4, True), (10, 3, False), (12, 3, True)], "group_id long, id long, active boolean")
    alerts = spark.createDataFrame([(10, "pendiente", 2), (11, "pendiente", 0), (12, "cerrada", 2)], "group_id long, status string, priority int")
    said = lambda **k: [(x.a, x.b, x.alerted) for x in selection.analysis_candidates(rel, art, mem, alerts, now(), **k).orderBy("place").collect()]
    assert said(limit=5) == [(1, 2, True), (2, 4, True), (3, 4, False)]
    assert said(limit=5, priority=1) == [(1, 2, True)] and said(limit=0) == []
    many = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"), F.lit("mismo_hecho").alias("relation_type"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("review_status"), now().alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    real = spark.range(200).withColumn("is_demo", F.col("id") < 3)
    assert [x.a for x in selection.analysis_candidates(many, real, mem, alerts, now(), 1).orderBy("place").collect()] == list(range(3, 10))


def test_pairs_in_either_order(spark):
    done = spark.createDataFrame([(1, 5, 6, "ok", T0), (2, 6, 5, "ok", T0), (3, 5, 6, "error", T0 + timedelta(1)), (4, 7, 8, "ok", T0), (5, None, 6, "ok", T0)], "id long, a long, b long, status string, created_at timestamp_ntz")
    pairs = spark.createDataFrame([(6, 5), (5, 6), (5, 6), (8, 7), (1, 2), (None, 6)], "a long, b long")
    assert {(r.a, r.b): r.analysis_id for r in selection.latest_of_pairs(pairs, done).collect()} == {(6, 5): 2, (5, 6): 2, (8, 7): 4, (1, 2): None}
    assert selection.both_ends(pairs, spark.createDataFrame([(5,), (6,), (6,), (1,)], "id long")).count() == 3


POST = "account_id long, external_id string, url string, text string, preview_title string, preview_text string, links array<string>, posted_at timestamp_ntz, is_repost boolean, forwarded_from string, views long, edited boolean"


def test_posts_keep_the_last_text(spark):
    post = lambda i, t, views=None, edited=False, title=None, account=1, at=T0: (account, i, "u", t, title, None, [], at, False, None, views, edited)
    schema = POST.replace("edited boolean", "search_text string, hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, edited_at timestamp_ntz")
    empty = spark.createDataFrame([], schema)
    first = spark.createDataFrame([post("1", "uno dos tres cuatro cinco", 5), post("2", "Ver https://x/y", title="El Título", edited=True), post("3", None), post(None, "x"), post("4", "a", account=None), post("1", "uno", 9, at=T0 - timedelta(1))], POST)
    one = merges.upsert_posts(empty, first, now())
    got = {r.external_id: r for r in one.collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].text == "uno dos tres cuatro cinco" and got["1"].edited_at is None and got["2"].edited_at == T0 and got["2"].search_text == "ver el titulo" and got["3"].search_text == ""
    second = spark.createDataFrame([post("1", "uno dos  tres cuatro cinco\n", None), post("2", "Ver https://x/y", 8, title="Otro"), post("5", "nuevo")], POST)
    two = {r.external_id: r for r in merges.upsert_posts(one.drop("outcome"), second, now(1)).collect()}
    assert {k: r.outcome for k, r in two.items()} == {"1": "seen", "2": "updated", "3": "kept", "5": "new"}
    assert two["1"].views == 5 and two["1"].last_seen_at == T0 + timedelta(1) and two["1"].edited_at is None and two["1"].text == "uno dos tres cuatro cinco"
    assert two["2"].views == 8 and two["2"].edited_at == T0 + timedelta(1) and two["2"].preview_title == "Otro" and two["2"].first_seen_at == T0
    again = merges.upsert_posts(merges.upsert_posts(one.drop("outcome"), second, now(1)).drop("outcome"), second, now(1))
    assert set(ids(again, "outcome")) == {"seen", "kept"}


def test_own_words(spark):
    df = spark.createDataFrame([("uno dos tres cuatro cinco https://x", "p"), ("uno https://x/y dos", "p q"), (None, None), ("solo", None)], "t string, p string")
    assert [r[0] for r in df.select(text.own_words(F.col("t"), F.col("p"))).collect()] == ["uno dos tres cuatro cinco", "uno dos p q", "", "solo"]


def test_imports_open_few_accounts(spark):
    data = [("Ana", 1, T0), ("ana", 2, T0), ("B", 3, T0), ("c", 4, T0), ("d", 0, T0 - timedelta(days=31)), (None, 5, T0), ("e", 6, None), ("x", 7, T0)]
    posts = spark.createDataFrame(data, "handle string, place long, posted_at timestamp_ntz")
    accounts = spark.createDataFrame([("X",), (None,)], "handle string")
    kept, opened = merges.admitted_posts(posts, accounts, now(), 30, new=2)
    assert ids(kept, "place") == [1, 2, 3, 7] and {(r.handle_key, r.handle) for r in opened.collect()} == {("ana", "Ana"), ("b", "B")}
    assert ids(merges.admitted_posts(posts, accounts, now(), most=2)[0], "place") == [0, 7]
    kept, opened = merges.admitted_posts(posts, accounts, now(), most=1)
    assert ids(kept, "place") == [7] and opened.count() == 0


def test_common_sources(spark):
    data = [
        (1, 1, "Según un informe del INDEC", None, None, False, None), (1, 2, "Sube todo", "Lo dice un ESTUDIO", None, False, None), (1, 2, "Sube todo", "Lo dice un ESTUDIO", None, False, None), (1, 3, "Informes varios", None, "Ana", False, None),
        (2, 4, "Un informe", None, None, None, None), (2, 5, "Nota", None, "Agencia EFE", False, None), (3, 6, "Nota", "", None, True, None), (3, 7, "Otra (NA)", None, "x", True, "NA"), (None, 8, "Un informe (na)", None, None, True, None),
        (4, 9, "En diálogo con Radio 10", None, None, False, None), (4, 10, "Le robaron mientras daba una entrevista", None, None, False, None),
    ]
    a = spark.createDataFrame(data, "group_id long, id long, title string, subtitle string, author string, is_syndicated boolean, origin_label string")
    got = {(r.group_id, r.kind): (r.n, r.ids, r.evidence) for r in common_source.common_sources(a).collect()}
    assert got == {(1, "informe"): (2, [1, 2], ["estudio", "informe"]), (2, "agencia"): (1, [5], ["agencia"]), (3, "agencia"): (2, [6, 7], ["(na)", "republicación (agencia)"])}
    assert common_source.common_sources(a.limit(0)).count() == 0


def test_messages_wait_longer_each_time(spark):
    schema = "id long, status string, attempts int, next_attempt_at timestamp_ntz, sent_at timestamp_ntz, last_error string"
    queue = spark.createDataFrame([(1, "pendiente", None, T0, None, None), (2, "pendiente", 0, T0, None, "old"), (3, "pendiente", 0, T0 + timedelta(1), None, None), (4, "error", 5, T0, None, "e"), (5, "pendiente", 0, T0, None, None)], schema)
    assert ids(merges.due_messages(queue, now())) == [1, 2, 5] and ids(merges.due_messages(queue, now(), 2)) == [1, 2]
    out = spark.createDataFrame([(1, "HTTP 500"), (1, "HTTP 500"), (2, None), (2, "x"), (4, "again"), (9, "x"), (None, "x")], "id long, error string")
    got = {r.id: (r.status, r.attempts, r.next_attempt_at, r.sent_at, r.last_error) for r in merges.after_attempts(queue, out, now()).collect()}
    assert got[1] == ("pendiente", 1, T0 + timedelta(minutes=1), None, "HTTP 500") and got[2] == ("enviada", 1, T0, T0, None) and got[4] == ("error", 5, T0, None, "e") and got[5] == ("pendiente", 0, T0, None, None)
    failed, waits = spark.createDataFrame([(1, "no")], "id long, error string"), []
    for _ in range(6):
        queue = spark.createDataFrame(merges.after_attempts(queue.where("id = 1"), failed, now()).collect(), schema)
        r = queue.first()
        waits.append((r.status, r.attempts, (r.next_attempt_at - T0).total_seconds() / 60))
    assert waits == [("pendiente", 1, 1), ("pendiente", 2, 5), ("pendiente", 3, 15), ("pendiente", 4, 60), ("error", 5, 60), ("error", 5, 60)]
