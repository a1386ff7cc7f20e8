"""Operators on hand-computed cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumewire import plans
from plumewire.functions import text as X
from plumewire.operators import evaluation, graph, groups, headlines, merges, metrics, relations

T0 = datetime(2026, 10, 14, 18)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def documents(spark, titles, media=None):
    n = len(titles)
    data = [(i, media[i] if media else i % 3, t, None, f"https://m{i}/a", False, True, T0 + timedelta(hours=i % 5), "datetime", T0, [1], [], [], f"m{i % 3}") for i, t in enumerate(titles)]
    assert n
    return spark.createDataFrame(data, "id long, media_id long, title string, subtitle string, canonical_url string, is_demo boolean, recent boolean, published_at timestamp_ntz, published_precision string, first_seen_at timestamp_ntz, topic_ids array<long>, linked_urls array<string>, mentioned_media array<string>, media_name string")


FILLER = ["Llega el frío polar a la costa sur", "Nuevo récord de turismo en la montaña", "Cierran una planta textil del conurbano", "Debate por el transporte escolar nocturno", "Campaña de vacunas contra la gripe", "Festival de cine premia cortos juveniles", "Obras demoran el tránsito del puente viejo", "Vuelve el tren de carga al puerto norte"]


def test_relation_rules(spark):
    titles = ["Aumentan los combustibles desde el lunes próximo", "AUMENTAN los combustibles desde el lunes próximo", "No aumentan los combustibles desde el lunes próximo", *FILLER]
    found = {(r.a, r.b): (r.relation_type, r.rules) for r in relations.find_relations(documents(spark, titles)).collect()}
    assert found[(0, 1)] == ("titular_identico", ["R1"])
    assert found[(0, 2)] == ("afirmaciones_distintas", ["RP"]) and found[(1, 2)][0] == "afirmaciones_distintas"
    assert all(a < 3 and b < 3 for a, b in found)


def test_relations_of_one_outlet_are_none(spark):
    titles = ["Aumentan los combustibles desde el lunes próximo"] * 2 + FILLER
    assert relations.find_relations(documents(spark, titles, media=[7, 7, *range(len(FILLER))])).count() == 0


def test_figures_block_identity(spark):
    titles = ["La inflación mensual fue de 3,1% según el organismo", "La inflación mensual fue de 3,4% según el organismo", *FILLER]
    found = {r.relation_type: r.rules for r in relations.find_relations(documents(spark, titles)).collect()}
    assert "titular_identico" not in found and "titular_casi_identico" not in found
    assert all("RN" in r for r in found.values())


def test_article_relations_read_the_whole_text(spark, tmp_path):
    shared = "Mientras tanto los astilleros zarparon hacia Ushuaia llevando turbinas hidroeléctricas, calderas oxidadas, bobinas trenzadas, válvulas niqueladas, grúas telescópicas, cojinetes cerámicos, tableros blindados, rodillos templados, alambiques cromados, hélices plegables, anclas forjadas y mástiles pulidos"
    opening = lambda i: " ".join(f"{'abcdefghijklm'[k]}{'nopqrstuvwxyz'[i % 13]}zq" for k in range(13)) + "."
    # Times follow from the ids: 0 and 11 are 12 hours apart, 0 and 22 a day, 0 and 1 more than five days.
    data = [(0, "alfa", f"{opening(0)}\n{shared}. Zafarrancho."), (11, "beta", f"{opening(1)}\n{shared}."), (1, "alfa", f"{opening(2)} {shared}."), (22, "gama", f"{opening(3)} Zafarrancho. Ver https://x/0, y ALFA."), (33, "gama", None)]
    data += [(100 + i, f"otro{i}", f"{opening(4 + i)} {t}") for i, t in enumerate(FILLER)]
    spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("lang", F.lit("es")).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.a, r.b, r.relation_type, r.rules[0]) for r in plans.QUERIES["article_relations"](spark, str(tmp_path)).collect()}
    assert (0, 11, "expresion_compartida", "R3") in found
    assert (0, 1, "reaparicion", "R6") in found and (0, 22, "referencia_explicita", "R7") in found
    assert {x for pair in found for x in pair[:2]} == {0, 1, 11, 22}


def test_weak_chain_is_not_merged(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (5, 6, 0.7), (5, 7, 0.6), (6, 7, 0.5), (8, 9, 0.9)], "a long, b long, score double")
    sims = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.5), (1, 3, 0.01), (5, 6, 0.5), (5, 7, 0.5), (6, 7, 0.5), (8, 9, 0.9)], "a long, b long, similarity double")
    media = spark.createDataFrame([(i, 1 if i in (8, 9) else i) for i in range(1, 10)], "id long, media_id long")
    none = spark.createDataFrame([], "a long, b long")
    assert rows(groups.cluster(edges, sims, media, none)) == [(1, 1), (1, 2), (5, 5), (5, 6), (5, 7)]
    rejected = spark.createDataFrame([(5, 7)], "a long, b long")
    assert rows(groups.cluster(edges, sims, media, rejected)) == [(1, 1), (1, 2), (5, 5), (5, 6)]


def test_clusters_in_rounds_are_those_of_one_task(spark):
    rng = random.Random(5)
    scores = {tuple(sorted(rng.sample(range(12), 2))): rng.choice([0.5, 0.7, 0.9]) for _ in range(16)}
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "a long, b long, score double")
    near = {(a, b): rng.choice([0.05, 0.13, 0.3, 0.6, 0.8]) for a in range(12) for b in range(a + 1, 12)}
    sims = spark.createDataFrame([(a, b, s) for (a, b), s in near.items()], "a long, b long, similarity double")
    media = spark.createDataFrame([(i, i % 3) for i in range(12)], "id long, media_id long")
    rejected = spark.createDataFrame(list(scores)[:2], "a long, b long")
    bad = set(list(scores)[:2])
    turns = edges.select("a", "b", F.struct(-F.col("score"), F.xxhash64("a", "b"), "a", "b").alias("t")).orderBy("t").collect()
    of = {i: {i} for i in range(12)}
    for e in turns:
        x, y = of[e.a], of[e.b]
        pairs = [(min(i, j), max(i, j)) for i in x for j in y]
        if x is not y and len(x | y) <= groups.MAX_SIZE and not bad & set(pairs) and min(near[p] for p in pairs) >= groups.MIN_PAIR and sum(near[p] for p in pairs) / len(pairs) >= groups.MIN_MEAN:
            for i in (union := x | y):
                of[i] = union
    want = sorted({(min(c), i) for c in of.values() if len({k % 3 for k in c}) > 1 for i in c}, key=repr)
    assert len(want) > 3
    assert rows(groups.cluster(edges, sims, media, rejected)) == want
    assert rows(groups.cluster(edges, sims, media, rejected, part=0)) == want


def test_components_of_long_chains_are_whole(spark):
    n = 100  # ids rise from both ends
    ids = [2 * i if i < n // 2 else 2 * (n - 1 - i) + 1 for i in range(n)]
    edges = spark.createDataFrame([(500, 500), (300, 301), *zip(ids, ids[1:])], "a long, b long")
    assert rows(groups.components(edges)) == rows(spark.createDataFrame([(i, 0) for i in range(n)] + [(300, 300), (301, 300), (500, 500)], "a long, b long"))


def test_groups_keep_their_old_ids(spark):
    new = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (2, 21)], "group_id long, id long")
    old = spark.createDataFrame([(100, 10), (100, 11), (200, 20), (200, 99), (200, 98), (200, 97)], "group_id long, id long")
    assert rows(groups.match_existing(new, old)) == [(1, 100)]
    # Both would rather have 7; the larger one chooses first, the other takes what is left.
    other = spark.createDataFrame([(1, i) for i in range(4)] + [(2, i) for i in range(3, 6)], "group_id long, id long")
    old = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (8, 4)], "group_id long, id long")
    assert rows(groups.match_existing(other, old)) == [(1, 7)]
    old = old.unionByName(spark.createDataFrame([(8, 5)], old.schema))
    assert rows(groups.match_existing(other, old)) == [(1, 7), (2, 8)]
    log = spark.createDataFrame([(T0, "remove", 1, 10, None), (T0, "merge", 2, None, 1)], "at timestamp_ntz, action string, group_id long, id long, target long")
    assert rows(groups.apply_corrections(new, log)) == [(1, 11), (1, 12), (1, 20), (1, 21)]


def test_description(spark):
    g = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "group_id long, id long")
    sims = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (1, 3, 0.2)], "a long, b long, similarity double")
    docs = spark.createDataFrame([(1, 1, "a", False), (2, 2, "b", True), (3, 2, "c", False)], "id long, media_id long, title string, is_syndicated boolean")
    r = groups.describe(g, sims, docs).first()
    assert (r.title, r.central_id, r.coherence_min, r.coherence_mean, r.media_ids, r.independent_media_ids) == ("b", 2, 0.2, 0.467, [1, 2], [1, 2])


def test_agenda(spark):
    week2, week1 = datetime(2026, 10, 13), datetime(2026, 10, 6)
    data = [(1, "a", week1, False), (2, "b", week1, False), (3, "a", week2, False), (4, "b", week2, False), (5, "a", week2, False), (6, "a", week2, False), (7, "b", week2, False), (8, "c", week2, False), (9, "b", week2, True)]
    articles = spark.createDataFrame(data, "id long, media_id string, first_seen_at timestamp_ntz, is_syndicated boolean")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (9, 3), (6, 3)], "id long, group_id long")
    r = {(x.media_a, x.media_b): x for x in metrics.agenda(articles, members).collect()}[("a", "b")]
    assert (r.shared, r.all_stories, r.stories_a, r.stories_b, r.jaccard) == (2, 5, 4, 3, 0.4)
    assert (r.containment_a, round(r.containment_b, 4), r.universe) == (0.5, 0.6667, 6)
    assert rows(metrics.exclusive_coverage(articles, members).where("media_id = 'a'")) == [("a", 4, 2, 2)]


def test_sequences(spark):
    data = [(g, m, T0 + timedelta(minutes=p) if p is not None else None, T0 + timedelta(minutes=d), False) for g, m, p, d in [(1, 1, 0, 5), (1, 2, 10, 5), (2, 1, 30, 9), (2, 2, 30, 4), (3, 1, None, 1), (3, 2, 5, 2)]]
    r = metrics.sequences(spark.createDataFrame(data, "group_id long, media_id long, published_at timestamp_ntz, first_seen_at timestamp_ntz, is_syndicated boolean")).first()
    assert (r.groups, r.pub_a_first, r.pub_b_first, r.pub_tie, r.pub_unknown) == (3, 1, 0, 1, 1)
    assert (r.det_a_first, r.det_b_first, r.det_tie, r.median_gap, r.q1) == (1, 1, 1, 5.0, None)


def test_rising_topic(spark):
    base = [(i, i % 3, T0 - timedelta(hours=3 * i, minutes=30), False) for i in range(0, 112)]
    extra = [(1000 + i, i % 2, T0 - timedelta(minutes=10 + i), i == 4) for i in range(6)]
    articles = spark.createDataFrame(base + extra, "id long, media_id long, published_at timestamp_ntz, is_syndicated boolean")
    daily = [("tarifas", i) for i in range(8, 112, 8)] + [("tarifas", 1000 + i) for i in range(6)] + [("clima", 3)]
    hits = spark.createDataFrame(daily, "slug string, id long")
    now = F.lit(T0.isoformat(sep=" ")).cast("timestamp_ntz")
    assert rows(metrics.rising_topics(hits, articles, now)) == [("tarifas", 5, 1.0, 4.0, 2)]
    assert metrics.rising_topics(hits, articles.where("id < 30 or id >= 1000"), now).count() == 0


def test_rollup_counts_once(spark):
    data = [(i, T0 + timedelta(hours=i), "feed", 1, "ok" if i % 3 else "error", 2) for i in range(10)]
    runs = spark.createDataFrame(data, "id long, started_at timestamp_ntz, run_type string, scope long, status string, items long")
    first = metrics.daily_rollup(runs.where("id < 5"))
    once = metrics.extend_rollup(first, runs)
    assert rows(once) == rows(metrics.daily_rollup(runs)) == rows(metrics.extend_rollup(once, runs))


def test_labels(spark):
    data = [(1, "correcta", "x", 10), (1, "correcta", "x", 10), (2, "correcta", "x", 10), (2, "incorrecta", "x", 10), (3, "incorrecta", "x", 10), (3, "dudosa", "x", 10), (4, "correcta", "y", 30), (5, "correcta", "y", 30)]
    labels = spark.createDataFrame(data, "item long, label string, stratum string, sample_population long")
    got = {r.stratum: (r.n, r.correct, r.population) for r in evaluation.by_stratum(labels).collect()}
    assert got == {"x": (2, 1, 10), "y": (2, 2, 30)}
    r = evaluation.weighted_precision(labels).first()
    assert round(r.precision, 4) == 0.875 and r.lo < 0.875 < r.hi <= 1
    a = evaluation.agreement(labels).first()
    assert a.agreement == 0.5
    items = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "item long, stratum string")
    assert evaluation.next_samples(items, labels.select("item"), 3).count() == 2


def test_headline_history(spark):
    data = [(1, 1, "feed", "Sube 3,1%", 0), (2, 1, "feed", "Sube 3,4%", 30), (3, 1, "site", "Otra cosa distinta", 10), (4, 1, None, "Una", 1), (5, 1, None, "Dos palabras", 2), (6, 2, "feed", "Nada cambia", 0)]
    v = spark.createDataFrame([(i, a, s, t, None, T0 + timedelta(minutes=m)) for i, a, s, t, m in data], "id long, article_id long, subsource_id string, title string, subtitle string, detected_at timestamp_ntz")
    assert sorted(r.id for r in headlines.transitions(v).collect()) == [2, 5]
    a = spark.createDataFrame([(1, 9), (2, 9)], "id long, media_id long")
    assert rows(headlines.change_stats(v, a)) == [(9, 2, 1, 2, 1, 30.0)]
    assert [r.id for r in headlines.change_list(v, "cifra").collect()] == [2]


ITEM = "media_id long, canonical_url string, source_id string, title string, subtitle string, author string, section string, body string, is_syndicated boolean, published_at timestamp_ntz, published_precision string, first_seen_at timestamp_ntz"


def test_article_upsert(spark):
    item = lambda url, sid, title, sub=None, syn=False, at=None: (1, url, sid, title, sub, None, None, None, syn, at, "datetime" if at else "none", T0)
    empty = spark.createDataFrame([], ITEM)
    first = merges.upsert_articles(empty, spark.createDataFrame([item("https://a/1", "s1", "Sube el dólar hoy fuerte"), item("ftp://x", None, "no"), item("https://a/2", None, " "), item("https://a/3", "s3", "Otro título de nota", "con bajada", True)], ITEM))
    assert {r.canonical_url: r.outcome for r in first.collect()} == {"https://a/1": "new", "https://a/3": "new"}
    held = first.drop("outcome")
    again = merges.upsert_articles(held, spark.createDataFrame([item("https://a/1", "s1", "Sube el dólar hoy fuerte")], ITEM))
    assert {r.canonical_url: r.outcome for r in again.collect()} == {"https://a/1": "seen", "https://a/3": "kept"}
    moved = merges.upsert_articles(held, spark.createDataFrame([item("https://a/1-new", "s1", "Sube fuerte el dólar hoy", at=T0), item("https://a/9", "s3", "Nada que ver esto"), item("https://a/3", None, "Otro título de nota")], ITEM))
    got = {r.canonical_url: r for r in moved.collect()}
    assert got["https://a/1"].outcome == "updated" and got["https://a/1"].published_at == T0
    assert got["https://a/9"].outcome == "new" and got["https://a/9"].source_id is None
    assert got["https://a/3"].outcome == "seen" and got["https://a/3"].subtitle == "con bajada" and got["https://a/3"].is_syndicated


def test_relation_merge(spark):
    old = spark.createDataFrame([(1, 2, "x", 0.5, "pendiente"), (3, 4, "x", 0.5, "pendiente"), (5, 6, "x", 0.5, "confirmada"), (7, 8, "x", 0.5, "pendiente")], "a long, b long, relation_type string, score double, review_status string")
    new = spark.createDataFrame([(1, 2, "x", 0.9), (5, 6, "x", 0.1), (9, 10, "x", 0.7)], "a long, b long, relation_type string, score double")
    loaded = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)], "id long")
    got = rows(merges.merge_relations(old, new, loaded))
    assert got == [(1, 2, "x", 0.9, "pendiente"), (5, 6, "x", 0.5, "confirmada"), (7, 8, "x", 0.5, "pendiente"), (9, 10, "x", 0.7, "pendiente")]


def test_alerts(spark):
    m = spark.createDataFrame([(1, 1, 1, False, None), (1, 2, 2, False, None), (2, 3, 1, False, "s"), (2, 4, 2, True, "s"), (3, 5, 1, False, "s"), (3, 6, 2, False, "s")], "group_id long, id long, media_id long, is_syndicated boolean, section string")
    rel = spark.createDataFrame([(1, "titular_identico", 0.9), (1, "mismo_hecho", 0.4)], "group_id long, relation_type string, score double")
    now = merges.evaluate_alerts(m, rel, 2, ["s"])
    assert rows(now.select("group_id", "independent", "priority")) == [(1, 2, 3)]
    none = spark.createDataFrame([], "group_id long, fingerprint string, priority int, media_ids array<long>, version int")
    first = merges.update_alerts(none, now)
    assert rows(first.select("group_id", "state", "version")) == [(1, "created", 1)]
    assert rows(merges.update_alerts(first.drop("state"), now).select("state", "version")) == [("unchanged", 1)]
    more = merges.evaluate_alerts(m.unionByName(spark.createDataFrame([(1, 9, 3, False, None)], m.schema)), rel)
    assert ("updated", 2) in rows(merges.update_alerts(first.drop("state"), more).where("group_id = 1").select("state", "version"))
    assert rows(merges.update_alerts(first.drop("state"), now.limit(0)).select("state")) == [("closed",)]
    sent = spark.createDataFrame([("alert:1:1",)], "dedupe_key string")
    assert merges.notifications(first, sent).count() == 0


def test_retention_and_csv(spark):
    a = spark.createDataFrame([(1, T0 - timedelta(days=99)), (2, T0 - timedelta(days=99)), (3, T0)], "id long, first_seen_at timestamp_ntz")
    kept, gone = merges.retention(a, [spark.createDataFrame([(2,)], "id long")], F.lit("2026-09-01").cast("timestamp_ntz"))
    assert rows(gone.select("id")) == [(1,)] and rows(kept.select("id")) == [(2,), (3,)]
    cells = merges.csv_cells(spark.createDataFrame([("=1+1", -5, None)], "a string, b int, c string")).first()
    assert tuple(cells) == ("'=1+1", "'-5", "")


def test_tone(spark):
    js = '{"enfoque": "igual", "tono_por_nota": [{"articulo": "A", "valoracion": "favorable"}, {"articulo": "B", "valoracion": "critico"}]}'
    res = spark.createDataFrame([(1, 5, True, js, [10, 11]), (1, 6, False, "{}", [10, 11])], "group_id long, id long, valid boolean, result string, article_ids array<long>")
    m = spark.createDataFrame([(10, 1), (11, 2)], "id long, media_id long")
    assert rows(metrics.tone(res, m)) == [(1, 1, 1, 0, 0, 0, True), (1, 2, 0, 1, 0, 0, True)]


def test_story_graph(spark):
    m = spark.createDataFrame([(1, 1, "a", ["x"], T0), (1, 2, "b", ["x", "y"], T0)], "group_id long, id long, title string, ents array<string>, first_seen_at timestamp_ntz")
    r = spark.createDataFrame([(1, 1, 2, "referencia_explicita")], "group_id long, a long, b long, relation_type string")
    p = spark.createDataFrame([(1, 7, 2)], "group_id long, post_id long, article_id long")
    nodes, edges = graph.story_graph(m, r, p)
    assert nodes.count() == 5 and edges.count() == 5
    assert rows(edges.where("directed").select("kind")) == [("post",), ("referencia_explicita",)]


def test_failures_count_to_the_nearest_second(spark):
    at = lambda s, us: datetime(2024, 1, 1, 0, 0, 0) + timedelta(seconds=s, microseconds=us)
    e = spark.createDataFrame([(1, "k", at(0, 400000)), (2, "k", at(3600, 600000)), (3, "k", at(3600, 500000))], "id long, key string, at timestamp_ntz")
    assert {r.id: r.n for r in metrics.recent_failures(e, 60).collect()} == {1: 1, 2: 2, 3: 2}


def test_due_sources_have_their_turns(spark):
    s = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=i * 37 % 11) if i % 4 else None) for i in range(60)], "id long, last_fetch_at timestamp_ntz")
    got = [r.id for r in metrics.in_turn(s.repartition(7)).orderBy("place").collect()]
    assert got == sorted(range(60), key=lambda i: (i % 4 != 0, i * 37 % 11 if i % 4 else 0, i))
    assert [r.place for r in metrics.in_turn(s).orderBy("place").collect()] == list(range(1, 61))


def test_counted_terms_are_not_grouped_again(spark):
    docs = [(i, [f"w{i % 3}", "a", "a"][: i % 4]) for i in range(12)]
    table = spark.createDataFrame(docs, "id long, words array<string>")
    one = relations.tf_idf(table.select("id", F.explode("words").alias("term")), 12, None)
    two = relations.tf_idf(table.select("id", F.inline(X.counts(F.col("words")))), 12, None)
    assert one.count() and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_partitions_follow_the_rows(spark):
    from plumewire.operators import shared

    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        shared.dealt_finely(spark, 40 * shared.ROWS + 1)
        assert spark.conf.get(names[0]) == "41"
        shared.dealt_finely(spark, 5)
        assert spark.conf.get(names[0]) == "41"
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
