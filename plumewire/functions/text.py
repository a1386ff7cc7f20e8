"""Text functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Latin letters that decompose into one base letter and marks, and their bases."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def once(value: Column, use) -> Column:
    """``use(value)``, the value worked out once a row: a lambda works out again, for each element, what it mentions."""
    return F.get(F.transform(F.array(value), use), 0)


def _words(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def clean_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


def strip_accents(c: Column) -> Column:
    """Letters without their marks; marks that stand alone go."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}", "")


def folded_in_place(c: Column) -> Column:
    """Lower case without accents, code point by code point, so that places are those of the text; marks that stand alone
    stay."""
    return F.translate(F.lower(F.translate(c, "\u0130", "i")), *_accents())


def norm(c: Column) -> Column:
    return clean_space(strip_accents(F.lower(c)))


def raw_tokens(c: Column) -> Column:
    """Numbers with their marks, and words joined by hyphen or apostrophe, in order."""
    return F.regexp_extract_all(norm(F.coalesce(c, F.lit(""))), F.lit(L.WORD), F.lit(0))


def counts(tokens: Column) -> Column:
    """array<struct<term, tf>>: the distinct tokens with their numbers, from the runs of the sorted ones."""

    def runs(held: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        one = lambda at: F.transform(at, lambda i, k: F.struct(F.get(held, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(held)) - i).cast("long").alias("tf")))
        return F.when(F.size(held) > 0, once(first, one))

    return once(F.array_sort(tokens), runs)


def is_number(token: Column) -> Column:
    return token.rlike("^[0-9]")


def light_stem(token: Column) -> Column:
    """Simple plurals; numbers and short words stay."""
    n = F.length(token)
    return (
        F.when(is_number(token) | (n <= 4), token)
        .when(token.endswith("ces") & (n > 5), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("z")))
        .when(token.endswith("es") & (n > 5) & ~F.substring(token, n - 2, F.lit(1)).isin(*"aeiou"), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("s") & F.substring(token, n - 1, F.lit(1)).isin(*"aeiou"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def content_tokens(c: Column) -> Column:
    """Tokens with content: negations and numbers as they are, other words stemmed."""
    keep = lambda t: t.isin(*L.NEGATIONS) | is_number(t) | (~t.isin(*L.STOPWORDS) & (F.length(t) > 1))
    stem = lambda t: F.when(t.isin(*L.NEGATIONS), t).otherwise(light_stem(t))
    return F.transform(F.filter(raw_tokens(c), keep), stem)


def with_bigrams(tokens: Column) -> Column:
    """The tokens and their adjacent pairs."""

    def add(t: Column) -> Column:
        rest = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.concat_ws("_", a, b))
        return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)

    return once(tokens, add)


def word_features(c: Column) -> Column:
    return with_bigrams(content_tokens(c))


def _runs(length: Column, size: int, pick, kind: str) -> Column:
    """``pick(start)`` for each start of a run of ``size`` in something of ``length``; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(length - size + 1, F.lit(1)))
    return F.when(length >= size, F.transform(starts, lambda i: pick(i, size))).otherwise(F.array().cast(kind))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of the tokens, with a blank at both ends."""
    letters = F.regexp_extract_all(F.concat(F.lit(" "), F.array_join(raw_tokens(c), " "), F.lit(" ")), F.lit("(?s)."), F.lit(0))
    return once(letters, lambda s: F.concat(*(_runs(F.size(s), n, lambda i, size: F.array_join(F.slice(s, i, F.lit(size)), ""), "array<string>") for n in range(low, high + 1))))


def numbers(c: Column) -> Column:
    """Distinct figures with their currency and unit; bare years are none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(L.NUMBER), F.lit(0)), lambda x: F.replace(clean_space(F.lower(x)), F.lit(" "), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"^(19|20)\d\d$"))))


def polarity(c: Column) -> Column:
    """struct(negated, cessation, markers)."""
    neg = F.filter(raw_tokens(c), lambda t: t.isin(*L.NEGATIONS))
    ces = F.regexp_extract_all(norm(F.coalesce(c, F.lit(""))), F.lit(L.CESSATION), F.lit(0))
    return F.struct((F.size(neg) > 0).alias("negated"), (F.size(ces) > 0).alias("cessation"), F.concat(neg, ces).alias("markers"))


def polarity_conflict(a: Column, b: Column) -> Column:
    """Why two similar texts do not say the same; null if they may."""
    return F.when(a["cessation"] != b["cessation"], "cessation").when(a["negated"] != b["negated"], "negation")


def _tells(word: Column) -> Column:
    return ~word.isin(*L.STOPWORDS, *L.DATE_WORDS) & ~is_number(word) & (F.length(word) > 2)


def expressive(phrase: Column, names: Column | None = None) -> Column:
    """Words of a phrase that carry content: no stop words, dates, figures or parts of names."""
    got = F.filter(F.split(phrase, " "), _tells)
    return got if names is None else F.filter(got, lambda w: ~F.array_contains(names, w))


def phrase_ngrams(c: Column, low: int = 3, high: int = 6) -> Column:
    """Distinct phrases of 3 to 6 words without stop words at their ends, with two expressive words or more.  A word is
    judged once, not again in each phrase, and only a text that has a formula somewhere looks for it in its phrases."""
    words = F.transform(raw_tokens(c), lambda w: F.struct(w.alias("word"), (~w.isin(*L.STOPWORDS)).alias("ends"), _tells(w).cast("int").alias("tells")))

    def grams(held: Column, size: int) -> Column:
        at = lambda i, k: F.get(held, i + k)
        fits = lambda i: at(i, 0)["ends"] & at(i, size - 1)["ends"] & (sum((at(i, k)["tells"] for k in range(1, size)), at(i, 0)["tells"]) >= 2)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(held) - size, F.lit(0))), fits)
        return F.transform(starts, lambda i: F.concat_ws(" ", *(at(i, k)["word"] for k in range(size))))

    formula = "|".join(L.BOILERPLATE)
    phrases = once(words, lambda held: F.array_distinct(F.concat(*(grams(held, size) for size in range(low, high + 1)))))
    plain = F.when(F.array_join(raw_tokens(c), " ").rlike(formula), F.filter(phrases, lambda p: ~p.rlike(formula))).otherwise(phrases)
    return F.array_sort(plain)


def maximal_phrases(phrases: Column) -> Column:
    """Phrases that are in no longer one, longest first.  The runs inside each phrase are taken away from them all: the
    work grows with the phrases, not with their pairs."""

    def inside(words: Column) -> Column:
        n = F.size(words)
        of_size = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), of_size))).otherwise(F.array().cast("array<string>"))

    kept = once(F.array_distinct(phrases), lambda every: F.array_except(every, F.flatten(F.transform(every, lambda k: once(F.split(k, " "), inside)))))
    return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])


def entities(c: Column, known: Column | None = None) -> Column:
    """Names and acronyms by their capitals.  A single word at the start counts only if it is in ``known``."""
    text = F.coalesce(c, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(L.ENTITY), F.lit(1))
    known = F.array().cast("array<string>") if known is None else known

    def name(e: Column, i: Column, starts: Column) -> Column:
        words = F.split(F.trim(e), r"\s+")
        first = starts & (i == 0)
        sure = F.upper(F.get(words, 0)) == F.get(words, 0)
        seen = F.array_contains(known, norm(F.get(words, 0)))
        drop = F.when(F.size(words) == 1, F.get(words, 0).isin(*L.ENTITY_STOP) | (first & ~sure & ~seen)).otherwise(F.lit(False))
        # stop words at the front go
        kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(*L.ENTITY_STOP), acc).otherwise(F.array_append(acc, w)))
        sentence = first & (F.size(kept) > 1) & ~(F.upper(F.get(kept, 0)) == F.get(kept, 0)) & ~F.array_contains(known, norm(F.get(kept, 0))) & ~F.array_contains(known, norm(F.array_join(kept, " ")))
        kept = F.when(sentence, F.slice(kept, F.lit(2), F.size(kept))).otherwise(kept)
        return F.when(~drop & (F.size(kept) > 0), norm(F.array_join(kept, " ")))

    names = once(text.rlike("^" + L.ENTITY), lambda starts: F.transform(found, lambda e, i: name(e, i, starts)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull())))


def quotes(c: Column) -> Column:
    """Quoted passages of three words or more."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(L.QUOTE), F.lit(1)), norm)
    return F.filter(found, lambda q: F.size(F.split(q, " ")) >= 3)


# Search


def search_text(c: Column) -> Column:
    return norm(F.coalesce(c, F.lit("")))


def search_tokens(c: Column) -> Column:
    """Words for whole-word search, with a blank at both ends."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(search_text(c), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))


def has_words(text: Column, query: str) -> Column:
    """Every word of the query is somewhere in the text."""
    out = F.lit(True)
    for w in query.split():
        out = out & F.contains(search_text(text), norm(F.lit(w)))
    return out


def has_term(tokens: Column, term: Column) -> Column:
    """The term as whole words; a term without letters or digits is nowhere."""
    t = search_tokens(term)
    return (F.length(F.trim(t)) > 0) & F.contains(tokens, t)


def term_pattern(terms: list[str]) -> str | None:
    """A pattern for ``search_text`` that finds any of the terms as whole words; None without terms."""
    plain = (unicodedata.normalize("NFKD", t.lower()) for t in terms)
    folded = [" ".join("".join(c for c in t if not unicodedata.combining(c)).split()) for t in plain]
    quoted = [r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in folded if t]
    return rf"(?U)\b(?:{'|'.join(quoted)})\b" if quoted else None


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of more than two characters."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(norm(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 2))
    return jaccard(words(a), words(b))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


# Cleaning


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the cleaned parts; a null part counts as empty and keeps its place."""
    return F.sha2(F.concat_ws("\x1f", *(clean_space(F.coalesce(p, F.lit(""))) for p in parts)), 256)


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def strip_html(c: Column) -> Column:
    """Text without tags; links, scripts and styles go with their text."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(a|script|style)(?=[\s/>]).*?(?:</\1\s*+>|\z)", " ")
    out = F.regexp_replace(out, r"<[^>]*+(?:>|\z)", " ")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(to))
    return clean_space(out)


def canonical_url(c: Column) -> Column:
    """https, host in lower case, no fragment, no tracking parameters, path and other parameters as they are."""
    c = F.trim(c)
    host = F.regexp_replace(F.lower(F.regexp_extract(c, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#]*)", 1)), r"\.?(:(80|443))?$", "")
    path = F.regexp_extract(c, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|" + "|".join(L.TRACKING) + r")(=|$)"))
    out = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(c.rlike(r"^(?i)https?://[^/?#]+"), out)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(norm(c), "[^a-z0-9]+", "-"), F.lit("-"))


def compact_count(c: Column) -> Column:
    """24.9K is 24900."""
    value = F.regexp_extract(F.trim(c), r"^([0-9]+(?:[.,][0-9]+)?)\s*[KkMm]?$", 1)
    unit = F.upper(F.regexp_extract(F.trim(c), r"([KkMm])$", 1))
    times = F.when(unit == "K", 1000.0).when(unit == "M", 1_000_000.0).otherwise(1.0)
    return F.when(value != "", F.bround(F.replace(value, F.lit(","), F.lit(".")).cast("double") * times).cast("long"))


def status_refs(urls: Column) -> Column:
    """array<struct(id, handle)> of status links; of several links to one status, one with a handle is preferred."""
    pattern = r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/(?:([A-Za-z0-9_]{1,15})|i/web)/status(?:es)?/([0-9]+)"
    got = F.filter(urls, lambda u: u.rlike(pattern))
    refs = F.transform(got, lambda u: F.struct(F.regexp_extract(u, pattern, 2).alias("id"), F.lower(F.regexp_extract(u, pattern, 1)).alias("handle")))
    ids = F.array_distinct(F.transform(refs, lambda r: r["id"]))
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.array_max(F.transform(F.filter(refs, lambda r: r["id"] == i), lambda r: r["handle"])).alias("handle")))


def own_words(text: Column, preview: Column, least: int = 5) -> Column:
    """A post's own words without addresses where there are enough of them, else with its preview."""
    own = clean_space(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", " "))
    return F.when(F.size(F.split(own, " ")) >= least, own).otherwise(clean_space(F.concat_ws(" ", own, preview)))


def safe_for_prompt(c: Column) -> Column:
    """struct(text, suspicious): delimiters taken out, and a flag for text that gives instructions."""
    flag = norm(c).rlike(r"\b(ignore|ignora|olvida|forget)\b.{0,40}\b(instruction|instruccion|previous|anterior)")
    return F.struct(F.regexp_replace(c, r"<{2,}|>{2,}|`{3,}|\[/?INST\]", " ").alias("text"), F.coalesce(flag, F.lit(False)).alias("suspicious"))


def numbers_supported(text: Column, source: Column) -> Column:
    """Every figure of the text is in the source or between 0 and 10."""
    small = F.array(*(F.lit(str(i)) for i in range(11)))
    return F.size(F.array_except(numbers(text), F.array_union(numbers(source), small))) == 0


# Headline changes


def subtitle_changed(old: Column, new: Column) -> Column:
    """Both subtitles are there and differ, and the shorter is not the other one cut off."""
    a, b = raw_tokens(old), raw_tokens(new)
    n, m = F.size(a), F.size(b)
    short, long_ = F.when(n < m, a).otherwise(b), F.when(n < m, b).otherwise(a)
    k = F.least(n, m)
    cut = (F.slice(long_, F.lit(1), F.greatest(k - 1, F.lit(0))) == F.slice(short, F.lit(1), F.greatest(k - 1, F.lit(0)))) & F.startswith(F.get(long_, k - 1), F.get(short, k - 1))
    return (k > 0) & (a != b) & ((n == m) | ~F.coalesce(cut, F.lit(False)))


def headline_facts(c: Column) -> Column:
    """What two headlines are compared by: text, tokens, content, nums, pol, ents, names (words of the names)."""
    ents = entities(c)
    return F.struct(
        F.coalesce(c, F.lit("")).alias("text"), raw_tokens(c).alias("tokens"), F.array_distinct(content_tokens(c)).alias("content"), numbers(c).alias("nums"), polarity(c).alias("pol"), ents.alias("ents"), F.flatten(F.transform(ents, content_tokens)).alias("names")
    )


def headline_changes(old: Column, new: Column, old_sub: Column, new_sub: Column) -> Column:
    """What a new version changed: cifra, negacion, nombre, reescritura (under half of the plain words in common),
    or else otro; only forma where the words are the same, only bajada where the title is.  ``old`` and ``new`` are
    ``headline_facts``."""
    plain = lambda f, names: F.filter(f["content"], lambda t: ~is_number(t) & ~F.array_contains(names, t))
    both = once(F.array_union(old["names"], new["names"]), lambda names: F.struct(plain(old, names).alias("old"), plain(new, names).alias("new")))
    similar = once(both, lambda p: F.when((F.size(p["old"]) == 0) & (F.size(p["new"]) == 0), 1.0).otherwise(jaccard(p["old"], p["new"])))
    none = F.array().cast("array<string>")
    cats = F.array(
        F.when(old["nums"] != new["nums"], "cifra"),
        F.when((old["pol"]["negated"] != new["pol"]["negated"]) | (old["pol"]["cessation"] != new["pol"]["cessation"]), "negacion"),
        F.when(old["ents"] != new["ents"], "nombre"),
        F.when(similar < 0.5, "reescritura"),
    )
    cats = F.filter(cats, lambda x: x.isNotNull())
    return (
        F.when(old["text"] == new["text"], F.when(subtitle_changed(old_sub, new_sub), F.array(F.lit("bajada"))).otherwise(none))
        .when(old["tokens"] == new["tokens"], F.array(F.lit("forma")))
        .otherwise(F.when(F.size(cats) > 0, cats).otherwise(F.array(F.lit("otro"))))
    )


def phrase_windows(c: Column, longest: int) -> Column:
    """All runs of 2 to ``longest`` tokens."""
    return once(raw_tokens(c), lambda tokens: F.concat(*(_runs(F.size(tokens), n, lambda i, size: F.array_join(F.slice(tokens, i, F.lit(size)), " "), "array<string>") for n in range(2, longest + 1))))
