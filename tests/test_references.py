"""Mentions, highlights, outlet rules, JSON-LD graphs, answers, reports, streams with timers."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumewire.functions import answers, attribution
from plumewire.operators import highlight, mentions, merges, metrics, reports
from plumewire.sources import adapters, pages
from plumewire.streaming import alerts, stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Mentions

NAMES = [("La Nación", 1), ("La Nación Argentina", None), ("Página/12", 2), ("Página 12", 2), ("TN", 3), ("El País", 4), ("El País Semanal", 5), ("País Semanal Hoy", 6), ("A24", 7), ("élite", 8)]


def brute_mentions(text, names):
    """Leftmost longest by regular expressions."""
    text = re.sub(r"[\s\xa0]+", " ", text or "").strip()
    found, at = [], 0
    while at < len(text):
        best = None
        for phrase, _ in names:
            m = re.compile(r"(?<![^\W_])" + re.escape(phrase) + r"(?![^\W_])").match(text, at)
            if m and (best is None or len(phrase) > len(best)):
                best = phrase
        if best:
            found.append((at, at + len(best), best))
        at += len(best) if best else 1
    return found


@pytest.mark.parametrize("most", [mentions.PHRASES, 3])
def test_mentions_against_regular_expressions(spark, most):
    """By the trie, and by the first word beyond the checked size."""
    r = random.Random(1)
    bits = ["La", "Nación", "Argentina", "Página/12", "Página", "12", "TN", "tn", "El", "País", "Semanal", "Hoy", "A24", "A2", "élite", "Élite", ",", ".", "\n", "  ", "_", "xTN"]
    texts = [(i, r.choice([" ", "", "  "]).join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 30)))) for i in range(120)] + [(200, None), (201, ""), (202, "La Nación"), (203, "dijo El País Semanal Hoy")]
    table = spark.createDataFrame(texts, "id long, text string")
    known = spark.createDataFrame(NAMES, "phrase string, media long")
    want = sorted((i, b, e, p) for i, t in texts for b, e, p in brute_mentions(t, NAMES))
    assert sorted(map(tuple, mentions.phrase_matches(table, known, most).select("id", "begin", "end", "phrase").collect())) == want
    assert len(want) > 100


def test_references_in_one_table(spark):
    texts = spark.createDataFrame([(1, "x " * 50 + "Según TN y La Nación Argentina, TN dice " + "y " * 50, 9), (2, "TN", 3), (3, None, None)], "id long, text string, own long")
    links = [(1, 0, "https://www.elpais.com/n?utm_source=x", True, 9), (1, 1, "https://m.tn.com.ar/a", True, 9), (1, 2, "https://tn.com.ar/b", False, 9), (1, 3, "https://nottn.com.ar/b", True, 9), (2, 0, "https://tn.com.ar/own", True, 3), (1, 4, "https://www.elpais.com/n?utm_source=x", True, 9)]
    hosts = spark.createDataFrame([("elpais.com", 4), ("TN.com.ar", 3)], "domain string, media long")
    found = mentions.references(texts, spark.createDataFrame(links, "id long, place int, url string, in_article boolean, own long"), spark.createDataFrame(NAMES, "phrase string, media long"), hosts)
    got = {(x.id, x.media, x.kind): x.evidence for x in found.collect()}
    assert set(got) == {(1, 3, "mencion"), (1, 4, "enlace"), (1, 3, "enlace")}
    assert got[1, 3, "mencion"].startswith("…x x") and "Según TN y La" in got[1, 3, "mencion"] and got[1, 3, "mencion"].endswith("…")
    cited = mentions.cited(found).first()
    assert sorted(cited.mentioned_media) == [3, 4] and sorted(cited.linked_urls) == ["https://m.tn.com.ar/a", "https://www.elpais.com/n"]
    many = spark.createDataFrame([(1, i, f"https://elpais.com/{i:03}", True, 9) for i in range(30)], "id long, place int, url string, in_article boolean, own long")
    assert sorted(x.evidence for x in mentions.link_references(many, hosts).collect()) == [f"https://elpais.com/{i:03}" for i in range(20)]


# Highlights


def test_highlight_spans(spark):
    text = "El  Presidente dijo: «la inflación baja», y la Inflación BAJA 3,5%; los préstamos no."
    data = [(1, text, ["la inflacion baja"], ["prestamo", "3,5%"]), (2, None, ["x"], ["y"]), (3, "nada que ver", [], None), (4, "uno dos tres cuatro", ["uno dos", "dos tres"], ["cuatro"]), (5, "los los los", [""], ["lo"])]
    got = {x.id: [tuple(s) for s in x.spans] for x in highlight.highlights(spark.createDataFrame(data, "id long, text string, phrases array<string>, terms array<string>")).collect()}
    assert [(text[b:e], k) for b, e, k in got[1]] == [("la inflación baja", "frase"), ("la Inflación BAJA 3,5%", "ambos"), ("préstamos", "termino")]
    assert got[2] == [] and got[3] == [] and got[4] == [(0, 19, "ambos")] and got[5] == []


# Pages


def test_links_of_unclosed_anchors(spark):
    html = "<a href=1>x <a href=2>y</a> <a href=3>z<!-- <a href=4>no</a> --><script>'<a href=5>'</script>"
    got = pages.links(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string")).orderBy("place").collect()
    assert [(x.place, x.href, x.text) for x in got] == [(0, "1", "x"), (1, "2", "y"), (2, "3", "z")]


@pytest.mark.parametrize("part", ["<!--", "<title>", "<script>", "<a ", "<a href=1>", "<article>", "<h2>", "<script "])
def test_pages_take_linear_time(spark, part):
    import time

    table = spark.createDataFrame([(1, "https://a/", part * (1_000_000 // len(part)))], "page_id long, url string, html string")
    small = table.withColumn("html", F.lit("<p>"))
    for work in (pages.links, pages.page_tags, pages.section_links):
        work(small).collect()
        began = time.perf_counter()
        work(table).write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - began < 10, (part, work.__name__)


BLOCKS = """<script type="application/ld+json">[{"@type": "WebSite", "datePublished": "no"}, {"@graph": [{"@type": "Person", "name": "no"}, [{"@type": ["NewsArticle", "X"], "author": [{"name": "Ana  Paz"}, "Luis", ["Eva", {"name": 5}]], "keywords": "a, b"}]]}]</script>
<script>var x = {"@type": "Article", "datePublished": "no"}</script><script type='application/ld+json'>{not json</script>
<SCRIPT id=1 type="application/ld+json" >{"@type": "Article", "datePublished": "2026-01-02", "description": " A  text ", "author": "Ana Paz", "isAccessibleForFree": "False", "@graph": {"@type": "BlogPosting", "dateModified": "2026-01-03", "author": {"name": "Zoe"}}}</SCRIPT>
<!-- <script type="application/ld+json">{"@type": "Article", "datePublished": "1999"}</script> -->"""


def test_ld_graphs_of_every_block_and_depth(spark):
    table = spark.createDataFrame([(1, "u", BLOCKS), (2, "v", "<p>"), (3, "w", None), (1, "u", BLOCKS)], "page_id long, url string, html string")
    kinds = pages.ld_objects(table).select(F.try_variant_get("v", "$['@type']", "string").alias("t"), "place").collect()
    assert len(kinds) == 6  # website, graph, person, news article, article, blog posting; both copies of the page are one
    every = pages.metadata(table).collect()
    got = {x.page_id: x for x in every}
    assert len(every) == 4
    x = got[1]
    assert (x.published_raw, x.modified_raw, x.description, x.keywords, x.has_paywall) == ("2026-01-02", "2026-01-03", "A text", ["a", "b"], True)
    assert x.authors == ["Ana Paz", "Luis", "Eva", "Zoe"] and got[2].authors == [] and not got[3].has_paywall
    deep = "[" * 9 + '{"@type": "Article", "datePublished": "deep"}' + "]" * 9
    one = spark.createDataFrame([(1, "u", f'<script type="application/ld+json">{deep}</script>')], "page_id long, url string, html string")
    assert pages.metadata(one).first().published_raw == "deep"


def test_channel_posts(spark):
    post = '<div class="tgme_widget_message_wrap x"><div data-post="Chan/7"><div class="tgme_widget_message_text y">uno<br/>dos <a href="https://a/1">enlace</a></div><span class="tgme_widget_message_views">1.2K</span><div class="message_meta">edited <time datetime="2026-01-02T03:04:05+00:00"></time></div></div>'
    other = post.replace("Chan/7", "Otro/8")
    got = pages.channel_posts(spark.createDataFrame([("chan", "<html>" + post + other), ("x", "<p>")], "handle string, html string")).collect()
    assert len(got) == 1 and (got[0].external_id, got[0].links, got[0].views, got[0].edited) == ("7", ["https://a/1"], 1200, True) and got[0].text.startswith("uno\ndos")


def test_outlets_are_rows(spark):
    rules = [("a.com", "article", r"^/nota/", None, 1), ("a.com", "source_id", r"-(\d+)$", None, 1), ("a.com", "section", r"^/nota/eco", "economía", 1), ("a.com", "section", r"^/nota/([a-z]+)", None, 2), ("a.com", "origin", r"(?i)^wires?$", "Wire", 1), ("blog.a.com", "section", r"^/([^/]+)", "blog", 1)]
    items = [("https://www.a.com/nota/eco-pib-77", "x", "Por <b>Ana Paz</b>,", 1), ("https://a.com/nota/deportes/gol-5", None, "WIRE", 2), ("https://a.com/video/1", None, None, 3), ("https://blog.a.com/uno/dos", "z", None, 4), ("https://other.com/nota/1", None, None, 5), ("nota", None, None, 6), ("https://a.com/nota/eco-pib-77", None, "Télam.", 7)]
    table = spark.createDataFrame(items, "url string, section string, author string, n long")
    agencies = spark.createDataFrame([("télam", "Agencia Télam")], "author string, label string")
    got = {x.n: (x.domain, x.section, x.source_id, x.author, x.origin_label, x.is_syndicated) for x in adapters.adapted(table, spark.createDataFrame(rules, "domain string, field string, pattern string, value string, priority int"), agencies).collect()}
    assert got == {
        1: ("a.com", "economía", "77", "Ana Paz", None, False), 2: ("a.com", "deportes", "5", "WIRE", "Wire", True), 4: ("blog.a.com", "blog", None, None, None, False), 7: ("a.com", "economía", "77", "Télam.", "Agencia Télam", True),
    }


# Answers

SHAPE = {"same": ["si", "no"], "focus": "string", "sure": "boolean", "quotes": [{"of": ["A", "B"], "piece": "string"}]}
SCHEMA = "same string, focus string, sure boolean, quotes array<struct<of: string, piece: string>>"


def test_answers(spark):
    good = '{"same": "si", "focus": "x", "sure": true, "quotes": [{"of": "A", "piece": "Dijo  “hola” ayer"}]}'
    data = [
        (1, good), (2, f"Claro:\n```json\n{good}\n```\nListo."), (3, good.replace('"si"', '"quizas"').replace("true", '"true"')), (4, good.replace('"focus": "x", ', "").replace('"same"', '"extra": 1, "same"')), (5, "no sé"), (6, None),
        (7, good.replace("ayer", "mañana")), (8, good.replace('"A"', '"B"')), (9, good.replace("Dijo  “hola” ayer", "a")), (10, good.replace('[{"of"', '{"of"').replace("}]", "}")), (11, good.replace('"x"', '"' + "x" * 2001 + '"')), (12, "[]"),
    ]
    table = spark.createDataFrame(data, "id long, raw string").withColumn("sources", F.create_map(F.lit("A"), F.lit("El ministro dijo \"hola\" ayer."), F.lit("B"), F.lit("Otra nota")))
    got = {x.id: x for x in answers.validated(table, SHAPE, [("quotes", "of", "piece")], SCHEMA).collect()}
    assert {i: x.valid for i, x in got.items()} == {i: i in (1, 2) for i in range(1, 13)}
    assert got[1].result.quotes[0].of == "A" and got[2].result == got[1].result and got[5].result is None
    assert got[3].errors == ["$.same: value not allowed", "$.sure: not true or false"] and sorted(got[4].errors) == ["$: field missing: focus", "$: field not allowed: extra"]
    assert got[5].errors == got[6].errors == ["$: not JSON"] and got[7].errors == ["quotes[0]: piece not in its source: Dijo  “hola” mañana"] and got[8].errors == ["quotes[0]: piece not in its source: Dijo  “hola” ayer"]
    assert got[9].errors == ["quotes[0]: piece empty or too short"] and got[10].errors == ["$.quotes: not a list"] and got[11].errors == ["$.focus: text too long"] and got[12].errors == ["$: not an object"]


def test_summaries(spark):
    ok = '{"titulo": "Semana", "parrafos": ["Hubo 1.200 notas y 12,50 %, en 3 medios."], "limitaciones": []}'
    data = '{"n": 1.2, "p": 12.5}'
    texts = [
        (1, ok, data), (2, ok, None), (3, ok.replace("Semana", "Un medio Copió y coordinó"), data), (4, ok.replace('["Hubo', '["a", "b", "c", "d", "e", "Hubo'), data), (5, '{"titulo": "x", "parrafos": [], "limitaciones": []}', data), (6, "no", data), (7, None, data),
        (8, ok.replace('"limitaciones": []', '"limitaciones": "x"'), data), (9, ok.replace("3 medios", "11 medios; son verdaderos"), data), (10, ok.replace("Semana", "Originalidad, marco, campaña"), data),
    ]
    got = {x.id: x for x in answers.summaries(spark.createDataFrame(texts, "id long, raw string, data string")).collect()}
    assert [i for i, x in got.items() if x.valid] == [1] and got[1].result.titulo == "Semana" and got[2].result is None
    assert got[2].errors == ["figure not in the data: 1.2", "figure not in the data: 12.5"] and got[4].errors == got[5].errors == ["parrafos: from 1 to 5"] and got[6].errors == got[7].errors == ["$: not JSON"]
    assert [e.split(" (")[0] for e in got[3].errors] == ["not to be said: copio", "not to be said: coordin"] and got[8].errors == ["$.limitaciones: not a list"]
    assert [e.split(" (")[0] for e in got[9].errors] == ["not to be said: verdaderos", "figure not in the data: 11"] and [e.split(" (")[0] for e in got[10].errors] == ["not to be said: campana"]
    assert answers.summaries(spark.createDataFrame([], "id long, raw string, data string")).count() == 0


# Reports


def test_period_parts(spark):
    t = datetime(2026, 1, 10)
    art = [(1, "a", t, False, "datetime", "Ana"), (2, "a", t + timedelta(days=1), True, None, " "), (3, "b", t + timedelta(days=1), False, "date", None), (4, "a", t - timedelta(days=1), False, "datetime", "Ana"), (5, "b", t - timedelta(days=9), False, "date", "x")]
    a = spark.createDataFrame(art, "id long, media_id string, first_seen_at timestamp_ntz, is_syndicated boolean, published_precision string, author string")
    members = spark.createDataFrame([(1, 10), (3, 10), (2, 11)], "id long, group_id long")
    reviews = spark.createDataFrame([("relation", "confirmada", t), ("relation", "confirmada", t), ("alert", "pendiente", t), ("alert", "descartada", t - timedelta(days=9))], "target string, decision string, at timestamp_ntz")
    at = lambda x: F.lit(str(x)).cast("timestamp_ntz")
    parts = reports.period_report(a, members, reviews, at(t), at(t + timedelta(days=2)))
    got = {(x.section, x.media_id, str(x.day) if x.day else None, x.precision): (x.n, x.own, x.syndicated, x.signed, x.before) for x in parts["figures"].collect()}
    assert got["total", None, None, None] == (3, 2, 1, 1, 1) and got["media", "a", None, None] == (2, 1, 1, 1, 1) and got["day_media", "a", "2026-01-11", None] == (1, 0, 1, 0, 0)
    assert got["precision", "a", None, "none"][0] == 1 and got["days", None, "2026-01-11", None][0] == 2 and ("days", None, None, None) not in got
    assert rows(parts["reviews"]) == [("relation", "confirmada", 2)] and parts["own"].count() == 0
    alone = reports.own_notes(a, members.limit(0), at(t), at(t + timedelta(days=2)), top=1)
    assert rows(alone) == [("a", 1, 1, 1), ("b", 1, 3, 1)]


def test_entity_report(spark):
    a = spark.createDataFrame([(1, "m1", "Ana López habla", None, datetime(2026, 1, 1), ["ana lopez", "x y"]), (2, "m2", "Otra cosa", "con Ana Lopez", datetime(2026, 1, 2), ["ana lopez", "x y"]), (3, "m1", "Nada", None, datetime(2026, 1, 2), ["x y"])], "id long, media_id string, title string, subtitle string, first_seen_at timestamp_ntz, ents array<string>")
    got = metrics.entity_report(a, "Ana Lopez")
    assert rows(got["media"]) == [("m1", 1), ("m2", 1)] and rows(got["names"]) == [("x y", 2)] and got["days"].count() == 2


def test_repeated_attributions(spark):
    x = spark.createDataFrame([(1, "a", "Según el ministro, sube"), (1, "b", "Sube, según el ministro"), (1, "a", "Según el ministro, sube"), (2, "a", "Según el juez, baja")], "group_id long, media_id string, text string")
    got = attribution.repeated(x.select("group_id", "media_id", attribution.attributions(F.col("text")).alias("found"))).collect()
    assert [(r.group_id, r.media) for r in got] == [(1, ["a", "b"])]


def test_csv_file(spark, tmp_path):
    merges.write_csv(spark.createDataFrame([("=1+1", None), ("a;b", "-x")], "a string, b string").coalesce(1), f"file://{tmp_path}/c")
    text = next((tmp_path / "c").glob("*.csv")).read_bytes().decode()
    assert text == "a;b\r\n'=1+1;\r\n\"a;b\";'-x\r\n" or text.replace('""', "") == "a;b\r\n'=1+1;\r\n\"a;b\";'-x\r\n"


# Streams


def run_in_steps(spark, tmp_path, name, files, schema, make, columns, stops):
    """Each file is a batch; the query ends after each number of files in ``stops`` and goes on from its checkpoint."""
    source, out = tmp_path / f"{name}-in", f"file://{tmp_path}/{name}-out"
    source.mkdir()
    done = 0
    for stop in stops:
        for k in range(done, stop):
            spark.createDataFrame(files[k], schema).coalesce(1).write.mode("append").parquet(f"file://{source}/f{k:03}")
        done = stop
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"file://{source}")
        q = make(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/{name}-check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()), key=repr)


def with_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    alerts.use_rocksdb(spark)
    return lambda: spark.conf.set(key, old)


def test_cooldown_holds_updates_back(spark, tmp_path):
    t = datetime(2026, 1, 1, 12)
    m = lambda k: t + timedelta(minutes=k)
    files = [[("g", 1, m(0)), ("h", 1, m(1))], [("g", 2, m(10))], [("g", 3, m(20)), ("h", 1, m(21)), (None, 1, m(21))], [("z", 1, m(100))], [("z", 2, m(102))], [("g", 4, m(130))], [("z", 3, m(400))], [("z", 4, m(600))]]
    back = with_state_store(spark)
    try:
        make = lambda s: alerts.cooled_down(s, 60)
        columns = ["group_id", "version", "at", "delayed"]
        args = (files, "group_id string, version long, at timestamp", make, columns)
        whole = run_in_steps(spark, tmp_path, "whole", *args, [8])
        again = run_in_steps(spark, tmp_path, "again", *args, [2, 4, 6, 8])
    finally:
        back()
    got = [(g, v, d) for g, v, _, d in whole]
    assert ("g", 1, False) in got and ("g", 2, False) not in got and ("g", 2, True) not in got
    assert ("g", 3, True) in got and ("g", 4, False) in got and ("h", 1, False) in got and got.count(("h", 1, False)) == 1  # a timer fired; the newest version stands for both
    assert again == whole


def test_windows_tell_when_they_are_incomplete(spark, tmp_path):
    t = datetime(2026, 1, 1)
    files = [[("k", t + timedelta(days=day, hours=1, minutes=i)) for i in range(n)] for day, n in enumerate([10, 10, 12, 3, 9])] + [[("k", t + timedelta(days=9))]]
    back = with_state_store(spark)
    try:
        args = (files, "key string, at timestamp", lambda s: alerts.window_counts(s), ["begins", "n", "usual", "complete"])
        whole = run_in_steps(spark, tmp_path, "w", *args, [6])
        again = run_in_steps(spark, tmp_path, "w2", *args, [1, 4, 6])
    finally:
        back()
    assert [(n, u, c) for _, n, u, c in sorted(whole)] == [(10, None, True), (10, 10.0, True), (12, 10.0, True), (3, 10.0, False), (9, 10.0, True)]
    assert again == whole


def test_sliding_and_deduplicated(spark, tmp_path):
    t = datetime(2026, 1, 5, 10)
    data = [("a", t), ("a", t + timedelta(hours=1)), ("b", t), ("a", t + timedelta(days=1))]
    spark.createDataFrame(data, "key string, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = spark.readStream.schema("key string, ts timestamp").parquet(f"file://{tmp_path}/in")
    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    slid = run(stream.sliding_counts(s, "ts", "key", "48 hours", "24 hours"), "slid", "complete")
    assert {(x.key, str(x.start)[:10]): x.n for x in slid.collect()} == {("a", "2026-01-04"): 2, ("a", "2026-01-05"): 3, ("a", "2026-01-06"): 1, ("b", "2026-01-04"): 1, ("b", "2026-01-05"): 1}
    assert sorted(x.key for x in run(stream.deduplicated(s, "ts", ["key"]), "once", "append").collect()) == ["a", "a", "b"]
