"""Evaluation of stories for alerts against a plain loop, and what counts as a change."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumewire.operators import story_alerts as S

T0 = datetime(2026, 10, 14, 18)
GROUP = "group_id long, title string, terms array<string>, phrases array<string>"
MEMBER = "group_id long, id long, active boolean, media_id long, media_name string, title string, subtitle string, author string, section string, is_demo boolean, is_syndicated boolean, origin_label string, url string, published_at timestamp_ntz, published_precision string, first_seen_at timestamp_ntz"
RELATION = "id long, a long, b long, relation_type string, score double, review_status string, delta_seconds long, notes array<string>, phrases array<string>, rules array<string>"
ANALYSIS = "id long, a long, b long, status string, created_at timestamp_ntz, same_event string, focus string, flags array<string>"
TYPES = ["titular_identico", "titular_casi_identico", "expresion_compartida", "mismo_hecho", "mismo_tema", "afirmaciones_distintas"]


def member(g, i, media, title="Nota", active=True, demo=False, synd=False, section=None, seen=0, published=None):
    return (g, i, active, media, f"m{media}", title, None, None, section, demo, synd, None, f"u{i}", published, "datetime" if published else None, T0 + timedelta(hours=seen))


def frames(spark, groups, members, relations, analyses):
    return spark.createDataFrame(groups, GROUP), spark.createDataFrame(members, MEMBER), spark.createDataFrame(relations, RELATION), spark.createDataFrame(analyses, ANALYSIS)


def plain(group, members, relations, analyses, rules):
    """(skip, priority, reasons, warnings, phrases) of one group, relation by relation."""
    arts = [m for m in members if m[0] == group[0] and m[2]]
    arts = [m for m in arts if not m[9]] or arts
    own = {m[3] for m in arts if not m[10]}
    by_id = {m[1]: m for m in arts}
    best, reasons, warnings, phrases, any_ = rules.shared_topic, [S.TOPIC], [], [], False
    for r in sorted(relations):
        if r[1] not in by_id or r[2] not in by_id or r[5] == "rechazada":
            continue
        a, b = by_id[r[1]], by_id[r[2]]
        if a[3] == b[3] or a[10] or b[10]:
            continue
        any_ = True
        told = [n for n in r[7] or [] if "negación" in n or "dejó de" in n]
        if r[3] == "afirmaciones_distintas":
            told.append(f"Afirmaciones distintas entre {a[4]} y {b[4]}: no es el mismo mensaje.")
        warnings += [w for w in dict.fromkeys(told) if w not in warnings]
        phrases += [p for p in dict.fromkeys(r[8] or []) if p not in phrases]
        pair = [x for x in analyses if {x[1], x[2]} == {r[1], r[2]} and x[3] == "ok"]
        x = max(pair, key=lambda v: (v[4], v[0])) if pair else None
        rank = reason = None
        if x and x[5] == "si" and x[6] == "similar" and not x[7]:
            rank, reason = rules.shared_expression, S.FOCUS
        elif r[3] in S.EXPRESSION_TYPES:
            rank, reason = rules.shared_expression, S.EXPRESSION
        elif r[3] == "mismo_hecho":
            hours = abs(r[6] if r[6] is not None else (b[15] - a[15]).total_seconds()) / 3600
            if hours <= rules.same_event_hours:
                rank, reason = rules.same_event, f"mismo hecho a {hours:.0f} h (según {'publicación' if r[6] is not None else 'detección'})"
        if rank is not None and rank > best:
            best, reasons = rank, [reason]
        elif rank == best and reason not in reasons:
            reasons.append(reason)
    phrases += [p for p in dict.fromkeys(group[3] or []) if p not in phrases]
    skip = None
    if len(arts) < 2:
        skip = "menos de dos notas"
    elif len(own) < rules.least_media:
        skip = "menos medios independientes que el mínimo"
    elif all((m[8] or "").lower() in rules.excluded_sections for m in arts):
        skip = "sección excluida"
    elif any("prohibida" in m[5].lower() for m in arts):
        skip = "término excluido: Prohibida"
    elif not any_:
        skip = "sin relaciones entre medios independientes"
    elif best < rules.least_priority:
        skip = "prioridad menor que la mínima configurada"
    return skip, best, reasons + ([S.CAREFUL] if warnings else []), warnings, phrases[:8]


@pytest.mark.parametrize(("seed", "rules"), [(1, S.Rules(excluded_terms=("", "Prohibida"))), (2, S.Rules(least_priority=2, same_event=2, excluded_terms=("Prohibida",))), (3, S.Rules(least_media=3, shared_topic=1, excluded_terms=("Prohibida",), excluded_sections=()))])
def test_against_a_loop(spark, seed, rules):
    r = random.Random(seed)
    groups = [(g, None if g % 3 else "Título", None, r.choice([None, [], ["p1", "p9", "p9"]])) for g in range(40)]
    members = [member(g, g * 10 + k, r.randrange(4), r.choice(["Nota", "Otra", "La PROHIBIDA" if r.random() < 0.2 else "Más"]), r.random() < 0.9, r.choice([None, False, False, True]), r.choice([None, False, False, True]), r.choice([None, "Show", "deportes"] if g % 4 == 0 else [None, "x"]), r.randrange(60)) for g in range(40) for k in range(r.randrange(0, 6))]
    pairs = [(g * 10 + k, g * 10 + j) for g in range(40) for k in range(6) for j in range(k) if r.random() < 0.6]
    notes = [None, [], ["negación en una"], ["otra", "dejó de subir", "negación en una"]]
    relations = [(n, *pair, r.choice(TYPES), r.choice([None, 0.5, 0.9]), r.choice([None, "pendiente", "rechazada", "confirmada"]), r.choice([None, -3600 * 5, 3600 * 24, 86_401]), r.choice(notes), r.choice([None, ["p1", "p2"], ["p3"]]), None) for n, pair in enumerate(pairs)]
    analyses = [(n, *r.sample(pair, 2), r.choice(["ok", "ok", "error"]), T0 + timedelta(hours=r.randrange(2)), r.choice(["si", "no", None]), r.choice(["similar", "otro"]), r.choice([None, [], ["x"]])) for n, pair in enumerate(pairs * 2) if r.random() < 0.4]
    got = {x.group_id: (x.skip, x.priority, x.reasons, x.warnings, x.phrases) for x in S.evaluate(*frames(spark, groups, members, relations, analyses), rules).collect()}
    assert got == {g[0]: plain(g, members, relations, analyses, rules) for g in groups}
    assert len({v[0] for v in got.values()}) >= 3


def test_evidence(spark):
    members = [member(1, 11, 1, seen=2, published=T0 + timedelta(hours=3)), member(1, 12, 2, seen=1), member(1, 13, 3, seen=5, published=T0), member(1, 14, 1, "Informe de la agencia", synd=True), member(1, 15, 4, "Un informe", active=False)]
    relations = [(n, 11, 12, t, s, None, None, None, None, [f"R{n}"]) for n, (t, s) in enumerate([("mismo_tema", 0.4), ("mismo_hecho", None), ("titular_identico", 0.9)])] + [(9, 11, 14, "titular_identico", 1.0, None, None, None, None, None)]
    x = S.evaluate(*frames(spark, [(1, "t", [f"w{i}" for i in range(9)], None)], members, relations, [])).first()
    assert x.skip is None and x.level == "alta" and [i.id for i in x.relations] == [2, 0, 1] and [i.rules for i in x.relations] == [["R2"], ["R0"], ["R1"]]
    assert [a.id for a in x.articles] == [14, 12, 11, 13] and x.first_detected.id == 14 and x.first_published.id == 13 and x.timed == 2
    assert x.media_ids == [1, 2, 3] and len(x.terms) == 8 and [(s.kind, s.ids) for s in x.sources] == [("agencia", [14])] and x.types == ["mismo_hecho", "mismo_tema", "titular_identico"]


def test_nothing_and_repeats(spark):
    groups, members, relations, analyses = frames(spark, [(1, None, None, None), (2, "x", [], [])], [member(1, 11, 1), member(1, 12, 2)], [(1, 11, 12, "mismo_tema", None, None, None, None, None, None)], [])
    assert {x.group_id: (x.skip, x.level) for x in S.evaluate(groups, members, relations, analyses).collect()} == {1: (None, "baja"), 2: ("menos de dos notas", "baja")}
    assert S.evaluate(groups.limit(0), members, relations, analyses).count() == 0
    assert {x.skip for x in S.evaluate(groups, members.limit(0), relations.limit(0), analyses).collect()} == {"menos de dos notas"}


def test_changes(spark):
    base = [member(1, 11, 1), member(1, 12, 2), member(1, 13, 3, "Otra")]
    rel = [(1, 11, 12, "mismo_tema", 0.4, None, None, None, ["p"], None)]
    said = lambda members, relations, analyses=(): S.evaluate(*frames(spark, [(1, "t", None, None)], members, relations, list(analyses)))
    old = said(base, rel).cache()
    told = lambda new: S.changes(old, new).first().changed
    assert told(said(base, rel)) == [] and said(base, rel).first().fingerprint == old.first().fingerprint
    assert told(said([*base, member(1, 14, 4)], rel)) == ["media"]
    assert told(said(base[:2], rel)) == []
    assert told(said(base, [*rel, (2, 11, 13, "expresion_compartida", 0.9, None, None, ["negación"], ["q"], None)])) == ["priority", "phrases", "types", "warnings"]
    assert told(said([*base[:2], member(1, 13, 3, "Agencia EFE")], rel)) == ["sources"]
    assert told(said(base, rel, [(5, 12, 11, "ok", T0, "no", "similar", None)])) == ["analyses"]
    old.unpersist()
    assert S.changes(old.limit(0), old).count() == 0 and old.select(F.col("skip").isNull()).first()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_what_is_asked_for_is_collected(spark, small):
    from plumewire import plans

    members = [member(g, g * 10 + k, k) for g in range(3) for k in range(3)]
    rel = [(g, g * 10, g * 10 + 1, "mismo_hecho", 0.5, None, 3600, None, ["p"], None) for g in range(3)]
    done = [(1, 1, 0, "ok", T0, "si", "similar", None)] * 2
    x = S.evaluate(*frames(spark, [(g, "t", None, None) for g in range(3)], members, rel, done), S.Rules(excluded_terms=("Prohibida",)))
    told = plan(x.select("group_id", "skip", "priority", "warnings"))
    assert told.count("Exchange hashpartitioning") <= 9 and "origin_label, origin_label" not in told and "collect_list(struct(key" not in told
    assert [(r.group_id, len(r.relations), r.level) for r in x.orderBy("group_id").collect()] == [(0, 1, "alta"), (1, 1, "media"), (2, 1, "media")]  # a row of an analysis twice is one analysis
    assert "lineitem" not in plan(plans.QUERIES["evaluated_stories"](spark, small))  # the members are made once


def test_made_up_articles_where_there_are_no_others(spark):
    members = [member(1, 11, 1, demo=True), member(1, 12, 2, demo=True), member(2, 21, 1), member(2, 22, 2, demo=True), member(3, 31, 1), member(3, 32, 2, demo=True), member(3, 33, 3, active=False)]
    got = S.evaluate(*frames(spark, [(g, None, None, None) for g in (1, 2, 3)], members, [(1, 11, 12, "mismo_tema", None, None, None, None, None, None)], []))
    assert {r.group_id: (r.skip, [a.id for a in r.articles]) for r in got.collect()} == {1: (None, [11, 12]), 2: ("menos de dos notas", [21]), 3: ("menos de dos notas", [31])}
