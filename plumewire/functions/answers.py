"""Answers of a model that must be JSON of a given shape and quote their sources: what is wrong with each.

Shapes are written as a dictionary: a type name ("string", "boolean", "number"), a list of allowed strings, a list with one
dictionary or type in it for an array, or a dictionary of fields, all of them required.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import NOT_IN_SUMMARY
from .text import norm, strip_accents

MAX_ITEMS, MAX_TEXT, LEAST_QUOTE = 30, 2000, 3


def repaired(raw: Column) -> Column:
    """The answer without a fence of backquotes around it, or words before its first and after its last brace."""
    inner = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(inner != "", inner).otherwise(raw)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1) == kind, F.lit(False))


def _said(wrong: Column, path: str, what: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.lit(f"{path}: {what}"))).otherwise(none)


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def shape_errors(v: Column, shape, path: str = "$", max_items: int = MAX_ITEMS, max_text: int = MAX_TEXT) -> Column:
    """What in a VARIANT is not as the shape says, as texts with the place of each."""
    none = F.array().cast("array<string>")
    if isinstance(shape, dict):
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), none)
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, shape)))), lambda k: F.concat(F.lit(f"{path}: field not allowed: "), k))
        inner = [F.when(F.array_contains(keys, key), shape_errors(_get(v, key), sub, f"{path}.{key}", max_items, max_text)).otherwise(F.array(F.lit(f"{path}: field missing: {key}"))) for key, sub in shape.items()]
        return F.when(_is(v, "OBJECT"), F.concat(extra, *inner)).otherwise(F.array(F.lit(f"{path}: not an object")))
    if isinstance(shape, list) and len(shape) == 1 and not isinstance(shape[0], str) or shape == ["string"]:
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(F.slice(items, 1, max_items), lambda x, i: F.transform(shape_errors(x, shape[0], "", max_items, max_text), lambda e: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"), e))))
        return F.when(_is(v, "ARRAY"), F.concat(_said(F.size(items) > max_items, path, "too many elements"), each)).otherwise(F.array(F.lit(f"{path}: not a list")))
    if isinstance(shape, list):
        return F.when(_is(v, "STRING"), _said(~F.try_variant_get(v, "$", "string").isin(*shape), path, "value not allowed")).otherwise(F.array(F.lit(f"{path}: not a text")))
    if shape == "string":
        return F.when(_is(v, "STRING"), _said(F.length(F.try_variant_get(v, "$", "string")) > max_text, path, "text too long")).otherwise(F.array(F.lit(f"{path}: not a text")))
    if shape == "boolean":
        return _said(~_is(v, "BOOLEAN"), path, "not true or false")
    return _said(F.try_variant_get(v, "$", "double").isNull() | _is(v, "STRING"), path, "not a number")


def _plain(c: Column) -> Column:
    """For the search of quotes: case, marks, white space and kinds of quotation marks don't count."""
    return F.regexp_replace(norm(c), "[\u201c\u201d\u00ab\u00bb\u2018\u2019\"']", "'")


def quote_errors(v: Column, sources: Column, quotes: list[tuple[str, str, str]]) -> Column:
    """Quoted pieces that are too short or not in their source.  quotes: (list, field that names the source, field with the
    piece); sources: map of names to texts."""
    def told(place: str, of: str, piece: str) -> Column:
        def wrong(x: Column, i: Column) -> Column:
            said = F.coalesce(_get(x, piece, "string"), F.lit(""))
            text = F.coalesce(F.try_element_at(sources, _get(x, of, "string")), F.lit(""))
            at = F.concat(F.lit(f"{place}["), i.cast("string"), F.lit("]: "))
            return F.when(F.length(_plain(said)) < LEAST_QUOTE, F.concat(at, F.lit("piece empty or too short"))).when(~F.contains(_plain(text), _plain(said)), F.concat(at, F.lit("piece not in its source: "), F.substring(said, 1, 80)))

        items = F.coalesce(F.try_variant_get(v, f"$['{place}']", "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(F.transform(items, wrong), lambda e: e.isNotNull())

    return F.concat(*(told(*q) for q in quotes)) if quotes else F.array().cast("array<string>")


def validated(answers: DataFrame, shape: dict, quotes: list[tuple[str, str, str]], schema: str) -> DataFrame:
    """The answers with valid, errors (texts) and result (of type ``schema``, null unless valid).  Quotes are looked for once the
    shape is right.  answers: raw, sources (map of names to texts) and others, which stay.

    Defined results: null, empty and text that is no JSON have one error; an answer in a fence or between words is read
    (``repaired``); answers with a key twice are no JSON."""
    v = F.try_parse_json(repaired(F.coalesce("raw", F.lit(""))))
    held = answers.withColumn("_v", v)
    shape_wrong = F.when(F.col("_v").isNull(), F.array(F.lit("$: not JSON"))).otherwise(shape_errors(F.col("_v"), shape))
    held = held.withColumn("_shape", shape_wrong)
    errors = F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(quote_errors(F.col("_v"), F.coalesce("sources", F.create_map().cast("map<string, string>")), quotes))
    held = held.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    return held.withColumn("result", F.when(F.col("valid"), F.from_json(F.to_json("_v"), schema, {"mode": "PERMISSIVE"}))).drop("_v", "_shape")


#: A summary's shape, and the figures that need no source.
SUMMARY = {"titulo": "string", "parrafos": ["string"], "limitaciones": ["string"]}
SUMMARY_SCHEMA = "titulo string, parrafos array<string>, limitaciones array<string>"
MAX_PARAGRAPHS, SMALL = 5, [str(i) for i in range(11)]


def figures(c: Column) -> Column:
    """The different figures of a text, with a point for the decimals and without zeros at their end."""
    plain = lambda n: F.when(F.contains(n, F.lit(".")), F.regexp_replace(n, r"\.?0*$", "")).otherwise(n)
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: plain(F.replace(n, F.lit(","), F.lit(".")))))


def summary_errors(v: Column, data: Column) -> Column:
    """What is wrong with a summary of the right shape: too few or many paragraphs, words that blame or judge (the first
    found of each kind), figures that are neither in the data nor small."""
    texts = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(F.coalesce(_get(v, "titulo", "string"), F.lit(""))), texts("parrafos"), texts("limitaciones")), " ")
    n = F.size(texts("parrafos"))
    few = F.when((n < 1) | (n > MAX_PARAGRAPHS), F.lit(f"parrafos: from 1 to {MAX_PARAGRAPHS}"))
    plain = strip_accents(F.lower(whole))
    said = []
    for pattern, why in NOT_IN_SUMMARY:
        hit = F.regexp_extract(plain, f"(?U){pattern}", 0)
        said.append(F.when(hit != "", F.concat(F.lit("not to be said: "), hit, F.lit(f" ({why})"))))
    unknown = F.array_sort(F.array_except(figures(whole), F.array_union(figures(data), F.array(*map(F.lit, SMALL)))))
    return F.concat(F.filter(F.array(few, *said), lambda e: e.isNotNull()), F.transform(unknown, lambda x: F.concat(F.lit("figure not in the data: "), x)))


def summaries(answers: DataFrame) -> DataFrame:
    """Summaries with valid, errors and result (null unless valid).  answers: raw, data (the JSON text that was summed up)
    and others, which stay.  Null and empty answers, and text that is no JSON, have one error; null data has no figures."""
    held = answers.withColumn("_v", F.try_parse_json(F.coalesce("raw", F.lit(""))))
    held = held.withColumn("_shape", F.when(F.col("_v").isNull(), F.array(F.lit("$: not JSON"))).otherwise(shape_errors(F.col("_v"), SUMMARY)))
    held = held.withColumn("errors", F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(summary_errors(F.col("_v"), F.col("data")))).withColumn("valid", F.size("errors") == 0)
    return held.withColumn("result", F.when(F.col("valid"), F.from_json(F.to_json("_v"), SUMMARY_SCHEMA))).drop("_v", "_shape")
