"""Which parts of a text two articles share: spans in code points of the text as it is.

Words are found in the original text and compared in their folded form, so each folded word knows its place in the
original.  A word is marked by a phrase that runs over it or by a term; marked words that follow each other, with what is
between them, are one span.  A word is a row here: long texts are windows over many rows, not one large expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import light_stem, norm


def highlights(texts: DataFrame) -> DataFrame:
    """id, spans array<struct<begin, end, kind>> in order; kind is frase, termino, or ambos where both marked words of the
    span.  texts: id (one row each), text, phrases (folded words with blanks between), terms (folded words or their stems).

    Defined results: a null or empty text, or one without a marked word, has no span; empty phrases mark nothing; null
    phrases or terms are none; letters and their marks are matched as one folded letter and keep their own places."""
    none = F.array().cast("array<string>")
    phrases = F.filter(F.transform(F.coalesce("phrases", none), lambda p: F.filter(F.split(norm(p), " "), lambda w: w != "")), lambda p: F.size(p) > 0)
    text = F.coalesce("text", F.lit(""))
    word = r"(?U)\d+(?:[.,]\d+)*%?|\p{L}\p{M}*(?:\p{L}\p{M}*)*(?:[-'](?:\p{L}\p{M}*)+)*"
    held = texts.select("id", F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"), F.split(text, word, -1).alias("gaps"), phrases.alias("phrases"), F.coalesce("terms", none).alias("terms"))
    held = held.withColumn("folded", F.transform("words", norm)).where(F.size("words") > 0)
    # The longest phrase that begins at each word.
    reach = F.transform("folded", lambda _, i: F.coalesce(F.array_max(F.transform(F.filter("phrases", lambda p: F.slice("folded", i + 1, F.size(p)) == p), F.size)), F.lit(0)))
    gaps = F.slice("gaps", F.lit(1), F.size("words"))
    each = held.select("id", "terms", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("folded").alias("folded"), gaps.alias("gap"), reach.alias("reach"))).alias("k", "x"))
    up_to = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("x.gap") + F.length("x.word")).over(up_to)
    by_phrase = F.max(F.col("k") + F.col("x.reach")).over(up_to) > F.col("k")
    by_term = F.array_contains("terms", F.col("x.folded")) | F.array_contains("terms", light_stem(F.col("x.folded")))
    marked = each.select("id", "k", (end - F.length("x.word")).cast("int").alias("begin"), end.cast("int").alias("end"), by_phrase.alias("p"), by_term.alias("t")).where("p or t")
    run = F.col("k") - F.row_number().over(Window.partitionBy("id").orderBy("k"))
    spans = marked.withColumn("run", run).groupBy("id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.bool_or("p").alias("p"), F.bool_or("t").alias("t"))
    kind = F.when(F.col("p") & F.col("t"), "ambos").when(F.col("p"), "frase").otherwise("termino")
    found = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begin", "end", kind.alias("kind")))).alias("spans"))
    return texts.select("id").join(found, "id", "left").select("id", F.coalesce("spans", F.array().cast("array<struct<begin: int, end: int, kind: string>>")).alias("spans"))
