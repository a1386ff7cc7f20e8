"""Who a text names as its source: ordered patterns over the folded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import clean_space, folded_in_place, strip_accents

# Kinds and patterns in order; the last group of an attribution is the source's name.
_WHO = r"([^,.;:\"«»“”()\n]{3,70})"
PATTERNS = [
    ("fuentes", r"\bfuentes? (?:judiciales|oficiales|oficialistas|policiales|parlamentarias|diplomaticas|cercanas|allegadas|consultadas|de la causa|del gobierno|de la investigacion)\b"),
    ("fuentes", r"\bsegun (?:pudo saber|pudieron saber|trascendio)\b"),
    ("fuentes", r"\b(?:le |les )?(?:confirmaron|revelaron|deslizaron) a\b"),
    ("atribucion", r"\bsegun (?!pudo |pudieron |trascendio)(?:informo|informaron |indico |indicaron |confirmo |confirmaron |publico |difundio |consigna |detallo |explico )?" + _WHO),
    ("atribucion", r"\bde acuerdo (?:con|a) " + _WHO),
    ("declaraciones", r"\b(?:en (?:una )?entrevista con|entrevistado por|en dialogo con|en declaraciones a|en una charla con|dijo a)\b"),
    ("declaraciones", r"\b(?:descargo|rompio el silencio|se defendio|salio a responder|respondio a las (?:acusaciones|criticas|denuncias))\b"),
    ("redes", r"\b(?:en (?:su|sus) (?:cuenta|cuentas|redes|perfil)|en redes sociales|posteo|tuit|un video (?:publicado|que publico|difundido|que circula)|publico un (?:video|mensaje))\b"),
    ("comunicado", r"\b(?:comunicado|gacetilla|parte de prensa|conferencia de prensa|cadena nacional|anuncio oficial|vocero|portavoz)\b"),
    ("judicial", r"\b(?:la denuncia|una denuncia|denuncia penal|expediente|imputacion|requerimiento|dictamen|procesamiento|el fallo|sentencia|(?:el|la) fiscal|fiscalia|juzgado|jueza?|tribunal|camara federal)\b"),
    ("documento", r"\b(?:informe|relevamiento|encuesta|(?:un|el) estudio (?:de|del)|reporte|boletin oficial|decreto|resolucion|datos del indec)\b"),
    ("agencia", r"\(na\)|\b(?:noticias argentinas|telam|efe|afp|reuters|europa press|ansa|dpa|associated press|bloomberg)\b"),
]
LABELS = {
    "atribucion": "Atribución explícita", "fuentes": "Fuentes sin nombre", "declaraciones": "Declaraciones o descargo", "redes": "Publicación en redes o video", "comunicado": "Comunicado o conferencia",
    "judicial": "Denuncia o actuación judicial", "documento": "Informe, documento o norma", "agencia": "Agencia", "medio": "Otro medio",
}
_STOP = r"\s(?:que|quien|quienes|donde|cuando|para|porque|mientras|tras|y el|y la)\s.*$"
MOST = 12
MAX_BODY, AROUND = 20_000, 70


def _named(kind: str):
    key = lambda s: F.array_join(F.slice(F.split(F.regexp_replace(s, r"^(?:el|la|los|las|un|una|lo)\s+", ""), " "), 1, 4), " ")
    return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("source"), key(s).alias("key"))


def attributions(*parts: Column) -> Column:
    """array<struct(kind, source, key)> over the parts in order (title, subtitle, body); one for each kind and first four
    words of the source, ``MOST`` at most."""
    found = []
    for part in parts:
        folded = strip_accents(F.lower(F.coalesce(part, F.lit(""))))
        for kind, pattern in PATTERNS:
            hits = F.regexp_extract_all(folded, F.lit(pattern), F.lit(1 if _WHO in pattern else 0))
            source = lambda s: F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.regexp_replace(s, _STOP, ""), r"\s+", " ")), " "), 1, 7), " ")
            found.append(F.transform(F.transform(hits, source), _named(kind)))
    every = F.filter(F.concat(*found), lambda x: F.length(x["source"]) >= 3)
    first = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: (y["kind"] == x["kind"]) & (y["key"] == x["key"])))
    return F.slice(first, 1, MOST)


def repeated(articles: DataFrame) -> DataFrame:
    """group_id, kind, key, media: sources that two outlets of a group or more name.  articles: group_id, media_id, found."""
    rows = articles.select("group_id", "media_id", F.explode("found").alias("x"))
    return rows.groupBy("group_id", "x.kind", "x.key").agg(F.array_sort(F.collect_set("media_id")).alias("media")).where(F.size("media") >= 2)


def _label(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[kind]


def _hits(articles: DataFrame, most_body: int) -> DataFrame:
    """A row for each place where a pattern holds: id, order (part, pattern, number), kind, source, snippet, place.  What
    lies between the hits of a pattern tells where each of them is in the text."""
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(place).alias("place"), t.alias("text")) for i, (place, t) in enumerate([("titular", text("title")), ("bajada", text("subtitle")), ("cuerpo", F.substring(text("body"), 1, most_body))])))
    rows = articles.select("id", F.inline(parts)).where("text <> ''").withColumn("folded", folded_in_place(F.col("text")))
    every = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        rx, named = f"(?U){pattern}", _WHO in pattern
        hits = F.regexp_extract_all("folded", F.lit(rx), F.lit(0))
        every.append(F.struct(F.lit(n).alias("pattern"), F.lit(kind).alias("kind"), F.lit(named).alias("named"), hits.alias("hits"), (F.regexp_extract_all("folded", F.lit(rx), F.lit(1)) if named else hits).alias("names"), F.split("folded", rx, -1).alias("gaps")))
    rows = rows.select("id", "part", "place", "text", F.inline(F.filter(F.array(*every), lambda p: F.size(p["hits"]) > 0)))
    before = lambda k: F.length(F.array_join(F.slice("gaps", F.lit(1), k + 1), "")) + F.length(F.array_join(F.slice("hits", F.lit(1), k), ""))
    spans = F.transform("hits", lambda h, k: F.struct(k.alias("k"), before(k).alias("begin"), F.length(h).alias("n"), F.length(F.get("names", k)).alias("n_name")))
    one = rows.select("id", "part", "place", "text", "pattern", "kind", "named", F.inline(spans)).withColumn("end", F.col("begin") + F.col("n"))
    name = F.substring("text", F.col("end") - F.col("n_name") + 1, F.col("n_name"))
    cut = F.length(F.get(F.split(folded_in_place(name), "(?U)" + _STOP.removesuffix(".*$"), 2), F.lit(0)))
    words = F.slice(F.split(clean_space(F.substring(name, F.lit(1), cut)), " "), 1, 7)
    source = F.when(F.col("named"), F.array_join(words, " ")).otherwise(clean_space(F.substring("text", F.col("begin") + 1, F.col("n"))))
    a, b = F.greatest(F.col("begin") - AROUND, F.lit(0)), F.least(F.length("text"), F.col("end") + AROUND)
    snippet = F.concat(F.when(a > 0, "…").otherwise(""), clean_space(F.substring("text", a + 1, b - a)), F.when(b < F.length("text"), "…").otherwise(""))
    return one.select("id", F.array(F.col("part"), F.col("pattern"), F.col("k")).alias("order"), "kind", source.alias("source"), snippet.alias("snippet"), "place").where(F.length("source") >= 3)


def found_attributions(articles: DataFrame, most: int = MOST, most_body: int = MAX_BODY) -> DataFrame:
    """id, found array<struct<kind, label, source, key, snippet, place>>: what articles name as their sources, in the order
    of title, subtitle, body (its first ``most_body`` code points), then the agency of one taken over, then the other
    outlets that it refers to.  One for each kind and first four words of the source, ``most`` at most.  Sources and snippets
    are of the text as it is.

    articles: id (one row each), title, subtitle, body, is_syndicated, origin_label, author, refs
    array<struct<media, evidence, kind>>.  Nulls count as empty; an article that names nothing has an empty list.  No text is
    shuffled, only what was found."""
    filled = lambda c: F.nullif(c, F.lit(""))
    taken = articles.where(F.coalesce("is_syndicated", F.lit(False))).select(
        "id", F.array(F.lit(3), F.lit(0), F.lit(0)).alias("order"), F.lit("agencia").alias("kind"), F.coalesce(filled("origin_label"), filled("author"), F.lit("agencia o tercero")).alias("source"),
        F.lit("Nota marcada como republicada (no cuenta como medio independiente).").alias("snippet"), F.lit("metadatos").alias("place"),
    )
    refs = articles.select("id", F.posexplode("refs").alias("k", "r")).select("id", F.array(F.lit(4), F.lit(0), F.col("k")).alias("order"), F.lit("medio").alias("kind"), F.coalesce("r.media", F.lit("")).alias("source"), F.coalesce("r.evidence", F.lit("")).alias("snippet"), F.when(F.col("r.kind") == "enlace", "enlace en el cuerpo").otherwise("mención").alias("place"))
    bare = F.regexp_replace(clean_space(folded_in_place(F.col("source"))), r"^(?:el|la|los|las|un|una|lo)\s+", "")
    every = _hits(articles, most_body).unionByName(taken).unionByName(refs).withColumn("key", F.array_join(F.slice(F.split(bare, " "), 1, 4), " "))
    first = every.groupBy("id", "kind", "key").agg(F.min(F.struct("order", "source", "snippet", "place")).alias("x"))
    one = F.struct(F.col("x.order").alias("order"), "kind", _label(F.col("kind")).alias("label"), F.col("x.source").alias("source"), "key", F.col("x.snippet").alias("snippet"), F.col("x.place").alias("place"))
    held = first.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("found"))
    listed = F.transform(F.slice("found", 1, most), lambda f: f.dropFields("order"))
    empty = F.array().cast("array<struct<kind: string, label: string, source: string, key: string, snippet: string, place: string>>")
    return articles.select("id").join(held.select("id", listed.alias("found")), "id", "left").select("id", F.coalesce("found", empty).alias("found"))


def shared_sources(articles: DataFrame) -> DataFrame:
    """group_id, place, kind, label, key, source, media, notes: sources that articles of two outlets of a group or more name,
    those of the most outlets, then articles, first.  ``source`` is as the article with the smallest id has it.
    articles: group_id, id, media, found (of ``found_attributions``)."""
    rows = articles.where("group_id is not null").select("group_id", "id", "media", F.inline("found").alias("kind", "label", "source", "key", "snippet", "where"))
    out = rows.groupBy("group_id", "kind", "label", "key").agg(F.min_by("source", F.struct("id", "source")).alias("source"), F.array_sort(F.collect_set("media")).alias("media"), F.count("*").alias("notes")).where(F.size("media") >= 2)
    order = Window.partitionBy("group_id").orderBy(F.desc(F.size("media")), F.desc("notes"), "label", "key")
    return out.select("group_id", F.row_number().over(order).alias("place"), "kind", "label", "key", "source", "media", "notes")
