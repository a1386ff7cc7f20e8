"""What articles name as their sources, with the text and the place of each, against a plain loop."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from plumewire.functions import attribution as A

ARTICLE = "id long, title string, subtitle string, body string, is_syndicated boolean, origin_label string, author string, refs array<struct<media: string, evidence: string, kind: string>>"


def fold(text):
    one = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
    return "".join(one(c) if len(one(c)) == 1 else c for c in text)


def plain(title, subtitle, body):
    found = {}
    for place, text in (("titular", title or ""), ("bajada", subtitle or ""), ("cuerpo", (body or "")[:20_000])):
        for kind, pattern in A.PATTERNS:
            for m in re.finditer(pattern, fold(text)):
                source = text[slice(*m.span())].split()
                if m.groups():
                    name = text[slice(*m.span(1))]
                    source = name[: len(re.split(A._STOP.removesuffix(".*$"), fold(name))[0])].split()[:7]
                source = " ".join(source)
                around = " ".join(text[max(0, m.start() - 70) : m.end() + 70].split())
                snippet = ("…" if m.start() > 70 else "") + around + ("…" if m.end() + 70 < len(text) else "")
                key = " ".join(re.sub(r"^(el|la|los|las|un|una|lo)\s+", "", " ".join(fold(source).split())).split()[:4])
                if len(source) >= 3:
                    found.setdefault((kind, key), (kind, A.LABELS[kind], source, key, snippet, place))
    return list(found.values())[:12]


def test_against_a_loop(spark):
    r = random.Random(4)
    parts = ["según informó", "Según", "el Ministro de Economía", "la fiscalía que investiga", "de acuerdo con", "fuentes judiciales", "FUENTES del Gobierno", ",", ".", "dijo a", "Télam", "(NA)", "un informe", "Jueza", "según trascendió", "😀", "İ", "él", "vocero", "\n", "  ", "posteó", "y la", "boletín oficial", "una  denuncia", "ñandú", "Reuters"]
    text = lambda n: None if r.random() < 0.1 else " ".join(r.choice(parts) for _ in range(r.randrange(n)))
    data = [(i, text(12), text(20), text(120), None, None, None, None) for i in range(60)]
    data += [(100, None, None, None, None, None, None, None), (101, "", "", "", False, "", "", []), (102, "x", None, "a " * 9_999 + "según el juez", None, None, None, None), (103, None, None, "según Ana, " * 20_000, None, None, None, None)]
    got = {x.id: list(map(tuple, x.found)) for x in A.found_attributions(spark.createDataFrame(data, ARTICLE)).collect()}
    assert got == {x[0]: plain(*x[1:4]) for x in data}
    assert max(map(len, got.values())) == 12 and got[100] == got[101] == []


def test_agency_and_outlets(spark):
    data = [
        (1, "Según Télam, sube", None, None, True, None, "NA", [("Perfil", "como dijo Perfil", "mencion"), ("perfil", "otra", "enlace"), (None, None, None)]), (2, "Nada", None, None, True, "", None, None), (3, "Nada", None, None, True, "Agencia X", "y", []),
    ]
    got = {x.id: [(f.kind, f.source, f.place) for f in x.found] for x in A.found_attributions(spark.createDataFrame(data, ARTICLE)).collect()}
    assert got[1] == [("atribucion", "Télam", "titular"), ("agencia", "Télam", "titular"), ("agencia", "NA", "metadatos"), ("medio", "Perfil", "mención"), ("medio", "", "mención")]
    assert got[2] == [("agencia", "agencia o tercero", "metadatos")] and got[3] == [("agencia", "Agencia X", "metadatos")]
    assert A.found_attributions(spark.createDataFrame([], ARTICLE)).count() == 0


def test_sources_that_outlets_share(spark):
    data = [(i, t, None, None, False, None, None, None) for i, t in enumerate(["Según el Ministro, sube", "Sube: según el ministro", "Según el ministro", "Un informe", "El informe", "Según el juez"])]
    found = A.found_attributions(spark.createDataFrame(data, ARTICLE))
    where = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (2, 1, "a"), (3, 1, "a"), (4, 1, "c"), (5, 1, "a"), (5, 2, "b"), (0, None, "z")], "id long, group_id long, media string")
    rows = A.shared_sources(where.join(found, "id")).orderBy("place").collect()
    assert [(x.group_id, x.place, x.kind, x.source, x.media, x.notes) for x in rows] == [(1, 1, "atribucion", "el Ministro", ["a", "b"], 3), (1, 2, "documento", "informe", ["a", "c"], 2)]
    assert found.where(F.size("found") == 0).count() == 0
