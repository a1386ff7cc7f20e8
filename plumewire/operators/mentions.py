"""Explicit references from texts and links to known outlets, in one table.

A dictionary has phrases (case counts, white space of any length is a blank) and whom each names; a phrase that names
nobody keeps a longer name from being taken for a shorter one ("La Nación" in "La Nación Argentina").  In a text the
longest phrase counts at each place, only between words, and the next one begins after it.

A dictionary of up to ``PHRASES`` phrases, which is checked, goes to each task as a trie over words; a larger one is joined by
the first word of its phrases, with the hot words dealt over ``SALTS`` tasks.  Both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical_url, clean_space
from .shared import shipped

PHRASES, SALTS = 20_000, 16
#: Code points of text on each side of a mention that its evidence has; links of a page that count; length of an address.
AROUND, MOST_LINKS, LONGEST_URL = 60, 20, 1000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_FOUND = "array<struct<begin: int, end: int, phrase: string>>"


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Words and single other characters, with their places."""
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]


def build_trie(phrases: list[str]) -> dict:
    """Tokens to the next ones; None leads to the phrase that ends here.  A blank between two tokens is part of the second."""
    root: dict = {}
    for phrase in phrases:
        node, last = root, None
        for begin, end, token in tokens(phrase):
            node = node.setdefault((last is not None and begin > last, token), {})
            last = end
        if last is not None:
            node[None] = phrase
    return root


def longest_matches(text: str, trie: dict) -> list[tuple[int, int, str]]:
    """Leftmost longest phrases of a text: begin, end, phrase."""
    found, all_, i = [], tokens(text), 0
    while i < len(all_):
        node, best, j, last = trie, None, i, None
        while j < len(all_):
            begin, end, token = all_[j]
            node = node.get((last is not None and begin > last, token))
            if node is None:
                break
            j, last = j + 1, end
            if None in node:
                best = (j, end, node[None])
        if best is None:
            i += 1
        else:
            found.append((all_[i][0], best[1], best[2]))
            i = best[0]
    return found


def phrase_matches(texts: DataFrame, phrases: DataFrame, most: int = PHRASES) -> DataFrame:
    """id, begin, end, phrase of every occurrence; places are code points of the text with its white space cleaned.
    texts: id (one row each), text; phrases: phrase."""
    spark = texts.sparkSession
    shipped(spark)
    rows = texts.select("id", clean_space(F.col("text")).alias("text")).where("text <> ''")
    known = phrases.select(clean_space(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    few = known.limit(most + 1).collect()
    if len(few) <= most:
        held = [r.phrase for r in few]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = build_trie(held)
            for b in batches:
                out = [[{"begin": x, "end": y, "phrase": p} for x, y, p in longest_matches(t, trie)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("phrase", pa.string())])))], ["id", "found"])

        found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, found {_FOUND}")
        return found.select("id", F.explode("found").alias("x")).select("id", "x.*")
    longest = known.agg(F.max(F.length("phrase"))).first()[0]
    kind = rows.schema["id"].dataType.simpleString()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                all_ = tokens(t)
                for k in range(0, len(all_), 4096):
                    some = all_[k : k + 4096]
                    ahead = [t[x : x + longest + 1] for x, _, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), b.schema.field(0).type), pa.array([x for x, _, _ in some], pa.int32()), pa.array([w for _, _, w in some]), pa.array(ahead)], ["id", "begin", "word", "ahead"])

    places = rows.mapInArrow(starts, f"id {kind}, begin int, word string, ahead string").withColumn("salt", F.pmod(F.xxhash64("id", "begin"), F.lit(SALTS)).cast("int"))
    first = F.regexp_extract("phrase", r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", 0)
    keyed = known.select("phrase", first.alias("word"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    inside = F.startswith("ahead", "phrase") & ~((F.substring("phrase", F.length("phrase"), F.lit(1)).rlike(r"[\p{L}\p{N}]")) & F.substring("ahead", F.length("phrase") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    hits = places.join(keyed, ["word", "salt"]).where(inside).groupBy("id", "begin").agg(F.max_by("phrase", F.length("phrase")).alias("phrase"))
    hits = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begin", (F.col("begin") + F.length("phrase")).alias("end"), "phrase"))).alias("hits"))
    # Of overlapping ones the first stays: a text's hits in order, each after the end of the last that stays.
    kept = F.aggregate("hits", F.array().cast(_FOUND), lambda acc, h: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= h["begin"]), F.array_append(acc, h)).otherwise(acc))
    return hits.select("id", F.explode(kept).alias("x")).select("id", "x.*")


def text_references(texts: DataFrame, dictionary: DataFrame, most: int = PHRASES) -> DataFrame:
    """id, media, kind (mencion), evidence: the first mention of each outlet in a text, but for the text's own one, with
    the text around it.  texts: id (one row each), text, own (media; may be null); dictionary: phrase, media (null: nobody)."""
    known = dictionary.select(clean_space(F.col("phrase")).alias("phrase"), "media")
    hits = phrase_matches(texts, dictionary, most).join(known.where("media is not null").distinct(), "phrase")
    first = hits.groupBy("id", "media").agg(F.min_by(F.struct("begin", "end"), F.struct("begin", "phrase")).alias("x"))
    told = first.join(texts.select("id", "own", clean_space(F.col("text")).alias("text")), "id").where(~F.col("media").eqNullSafe(F.col("own")))
    begin, end = F.greatest(F.lit(0), F.col("x.begin") - AROUND), F.least(F.length("text"), F.col("x.end") + AROUND)
    snippet = F.concat(F.when(begin > 0, "…").otherwise(""), F.trim(F.substring("text", begin + 1, end - begin)), F.when(end < F.length("text"), "…").otherwise(""))
    return told.select("id", "media", F.lit("mencion").alias("kind"), snippet.alias("evidence"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def link_references(links: DataFrame, hosts: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """id, media, kind (enlace), evidence (address): links inside articles to other outlets' hosts and what is under them, each
    address once, the first ``most`` of a page.  links: id, place, url, in_article, own (media); hosts: domain, media."""
    parts = F.split(host_of(F.col("url")), r"\.")
    under = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = links.where("in_article").select("id", "place", "url", "own", F.posexplode(under).alias("depth", "domain")).join(hosts.select(F.lower("domain").alias("domain"), "media"), "domain")
    # The longest domain that is known says whose the address is.
    whose = named.groupBy("id", "place", "url", "own").agg(F.min_by("media", F.struct("depth", "media")).alias("media")).where(~F.col("media").eqNullSafe(F.col("own")))
    once = whose.groupBy("id", "media", "url").agg(F.min("place").alias("place"))
    ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("place", "url"))).where(F.col("k") <= most)
    return ranked.select("id", "media", F.lit("enlace").alias("kind"), F.substring("url", 1, LONGEST_URL).alias("evidence"))


def references(texts: DataFrame, links: DataFrame, dictionary: DataFrame, hosts: DataFrame) -> DataFrame:
    """Mentions and links in one table: id, media, kind, evidence."""
    return text_references(texts, dictionary).unionByName(link_references(links, hosts))


def cited(found: DataFrame) -> DataFrame:
    """id, linked_urls (in their canonical form), mentioned_media: what ``relations`` compares articles by."""
    return found.groupBy("id").agg(F.collect_set(F.when(F.col("kind") == "enlace", canonical_url(F.col("evidence")))).alias("linked_urls"), F.collect_set("media").alias("mentioned_media"))
