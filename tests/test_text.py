"""Text functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from plumewire.functions import attribution, stats, text, time


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize("given, want", [("El dólar NO sube 3,1% en 2024", ["el", "dolar", "no", "sube", "3,1%", "en", "2024"]), ("Río-Plata d'Or", ["rio-plata", "d'or"]), (None, []), ("", []), ("¡!", [])])
def test_tokens(spark, given, want):
    assert one(spark, text.raw_tokens, given) == want


@pytest.mark.parametrize("given, want", [("las felices altas luces", ["feliz", "alta", "luce"]), ("no subieron los precios 3,1%", ["no", "subieron", "precio", "3,1%"]), ("unidades", ["unidad"]), ("casas", ["casa"])])
def test_content(spark, given, want):
    assert one(spark, text.content_tokens, given) == want


def test_features_and_ngrams(spark):
    assert one(spark, text.word_features, "suben precios hoy fuerte") == ["suben", "precio", "fuerte", "suben_precio", "precio_fuerte"]
    assert one(spark, text.word_features, "uno") == []
    assert one(spark, text.char_ngrams, "ab") == [" ab", "ab ", " ab "]


def test_numbers(spark):
    assert one(spark, text.numbers, "Sube 3,1% y $ 500 millones en 2024") == ["$500millones", "3,1%"]
    assert one(spark, text.numbers, None) == []


def test_polarity(spark):
    assert tuple(one(spark, text.polarity, "La inflación dejó de subir"))[:2] == (False, True)
    assert tuple(one(spark, text.polarity, "No habrá paro"))[:2] == (True, False)
    conflict = lambda a, b: text.polarity_conflict(text.polarity(a), text.polarity(b))
    assert one(spark, conflict, "Sube el pan", "Dejó de subir el pan") == "cessation"
    assert one(spark, conflict, "Sube el pan", "No sube el pan") == "negation"
    assert one(spark, conflict, "Sube", "Sube más") is None


def test_entities(spark):
    assert one(spark, text.entities, "Renunció Claudia Pérez en Córdoba") == ["claudia perez", "cordoba"]
    assert one(spark, text.entities, "Sube el pan") == []
    assert one(spark, text.entities, "El FMI y la CGT") == ["cgt", "fmi"]


def test_phrases(spark):
    got = one(spark, text.phrase_ngrams, "una fuerte suba del dolar blue")
    assert "fuerte suba del dolar" in got and "una fuerte suba" not in got
    got = one(spark, lambda c: text.maximal_phrases(text.phrase_ngrams(c)), "fuerte suba del dolar blue")
    assert got == ["fuerte suba del dolar blue"]


def test_quotes(spark):
    assert one(spark, text.quotes, "Dijo “no vamos a aflojar nunca” y “sí”") == ["no vamos a aflojar nunca"]


def test_whole_words(spark):
    term = lambda a, b: text.has_term(text.search_tokens(a), b)
    assert one(spark, term, "La tarifa del gas", "gas") and not one(spark, term, "Los gastos", "gas")
    assert not one(spark, term, "a  b", "¡!")


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&fbclid=1#top", "https://www.example.com/a/?b=2"), ("https://x.org", "https://x.org/"), ("https://x.org:8080/p?q=&utm_id=3", "https://x.org:8080/p?q="), ("ftp://x", None), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, text.canonical_url, url) == want


def test_hash_keeps_places(spark):
    h = lambda a, b: text.content_hash(a, b)
    assert one(spark, h, "a", None) != one(spark, h, None, "a")
    assert one(spark, h, " a  b ", None) == one(spark, h, "a b", "")


@pytest.mark.parametrize("raw, want", [("24.9K", 24900), ("1.2M", 1_200_000), ("521", 521), ("x", None)])
def test_counts(spark, raw, want):
    assert one(spark, text.compact_count, raw) == want


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("Suben 3,1% los precios", "Suben 3,4% los precios", ["cifra"]), ("Habrá paro mañana", "No habrá paro mañana", ["negacion"]), ("El precio del pan lactal sube mucho", "El precio del pan lactal dejó de subir mucho", ["negacion"]), ("SUBE el dólar", "Sube el dólar.", ["forma"]),
        ("Crece la industria del acero", "Llueve en toda la provincia", ["reescritura"]), ("Crece la industria del acero", "Crece la industria fuerte del acero", ["otro"]), ("Igual", "Igual", []),
    ],
)
def test_headline_changes(spark, old, new, want):
    f = lambda a, b: text.headline_changes(text.headline_facts(a), text.headline_facts(b), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert one(spark, f, old, new) == want


def test_subtitles(spark):
    assert one(spark, text.subtitle_changed, "uno dos tres", "uno dos cuatro") is True
    assert one(spark, text.subtitle_changed, "uno dos tres cuatro", "uno dos tr") is False
    assert one(spark, text.subtitle_changed, None, "uno") is False


def test_status_refs(spark):
    df = spark.createDataFrame([(["https://x.com/i/web/status/12", "https://twitter.com/Ana/status/12?s=1", "https://y.com"],)], "u array<string>")
    assert [tuple(r) for r in df.select(text.status_refs(F.col("u")).alias("x")).first().x] == [("12", "ana")]


def test_attributions(spark):
    got = one(spark, attribution.attributions, "Según informó la fiscalía que investiga el caso, hubo fuentes judiciales")
    assert ("atribucion", "la fiscalia", "fiscalia") in [tuple(x) for x in got] and any(x[0] == "fuentes" for x in got)


def test_wilson_and_quantiles(spark):
    r = spark.sql("SELECT 8 h, 10 n, array(1D, 2D, 3D, 4D, 10D) xs").select(stats.wilson(F.col("h"), F.col("n")).alias("w"), stats.exclusive_quantile(F.col("xs"), 0.25).alias("a"), stats.exclusive_quantile(F.col("xs"), 0.75).alias("b"), stats.median_of(F.col("xs")).alias("m")).first()
    assert round(r.w.lo, 4) == 0.4902 and round(r.w.hi, 4) == 0.9433
    assert (r.a, r.b, r.m) == (1.5, 7.0, 3.0)


@pytest.mark.parametrize(
    "raw, at, day, precision",
    [
        ("2026-10-06", None, "2026-10-06", "date"), ("2026-10-06T12:00:00-03:00", "2026-10-06 15:00:00", "2026-10-06", "datetime"), ("Tue, 06 Oct 2026 15:00:00 GMT", "2026-10-06 15:00:00", "2026-10-06", "datetime"), ("2026-10-06T22:00:00", "2026-10-07 01:00:00", "2026-10-06", "datetime"),
        ("nonsense", None, None, "none"), (None, None, None, "none"),
    ],
)
def test_feed_dates(spark, raw, at, day, precision):
    r = one(spark, time.feed_date, raw)
    assert (str(r.at) if r.at else None, str(r.day) if r.day else None, r.precision) == (at, day, precision)


def test_counts_of_tokens(spark):
    from plumewire.functions import text as X

    cases = [(1, ["b", "a", "b", "", "b"]), (2, []), (3, None), (4, ["x"])]
    got = {r.id: r.c and [tuple(x) for x in r.c] for r in spark.createDataFrame(cases, "id long, t array<string>").select("id", X.counts(F.col("t")).alias("c")).collect()}
    assert got == {1: [("", 1), ("a", 1), ("b", 3)], 2: None, 3: None, 4: [("x", 1)]}


def test_phrases_judge_each_word_once(spark):
    """Formulas and stop words as before; a phrase is not split again for its words."""
    from plumewire.functions import lexicon as L

    words = "lo que hay que saber del dolar blue en alza por 3 paritaria docente minuto a minuto".split()
    tells = lambda w: w not in L.STOPWORDS and w not in L.DATE_WORDS and not w[0].isdigit() and len(w) > 2
    runs = [words[i : i + n] for n in range(3, 7) for i in range(len(words) - n + 1)]
    runs = [r for r in runs if r[0] not in L.STOPWORDS and r[-1] not in L.STOPWORDS and sum(map(tells, r)) >= 2]
    want = sorted({" ".join(r) for r in runs if not any(b in " ".join(r) for b in L.BOILERPLATE)})
    assert len(want) > 3 and one(spark, text.phrase_ngrams, " ".join(words)) == want
    assert one(spark, text.phrase_ngrams, "dolar blue") == [] and one(spark, text.phrase_ngrams, None) == []
    assert "split(" not in str(text.phrase_ngrams(F.col("c")))
