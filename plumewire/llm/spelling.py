"""Spelling variants by wildcard groups, without pairs.

Words that differ by one replaced code point share a group (position, prefix, suffix).  A group keeps its size and its
top two words, which is all that a member needs: how many others there are, and the best of them that it isn't itself.
Words that differ by one inserted code point meet where a deletion of the longer one joins the vocabulary: that group has
the shorter word first and then the longer ones.  So each word has a row for each of its groups, and no pair is made.

A word's id follows its rank (more occurrences first, ties in code-point order), so the best word is the smallest id.
A group's key is a 128-bit digest of position, prefix and suffix: sums of mixed (position, code point) pairs, which give
all groups of a word in time proportional to its length.  A wildcard group has at most as many words as the alphabet of
the words has letters, and a deletion's at most that times its length, so no group is hot, however large the corpus is.
The forms of forms are followed by doubling; n grows tenfold at each step, so a few rounds are enough.

Defined results: a null or empty text has no words; a null doc_id counts as the empty string where words are derived; a
very long text, or a very long word, is taken whole; repeated rows (ties) count as often as they are there; an empty table
has no words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, mix64, stage, text_bytes

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) pairs loses a letter before the words are counted.
DAMAGE = 31
#: Words that a task counts before it hands the counts on.
HELD = 200_000

_ITSELF, _DELETION, _REPLACED = 0, 1, 2


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n: partial counts of the words of the texts, after the damage."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars).findall
        crc, found = zlib.crc32, Counter()
        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not body:
                    continue
                head = crc(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(runs(body.lower().decode("utf-8", "replace"))).items():
                    h = crc(word.encode(), head)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    found[word] += n
            if len(found) > HELD:
                yield batch(schema, list(found), list(found.values()))
                found.clear()
        yield batch(schema, list(found), list(found.values()))

    return text_bytes(docs).mapInArrow(lean(run), "word string, n long")


def vocabulary(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """id, word, n of the words with ``min_count`` occurrences; ids grow as n falls, then in code-point order."""
    words = stage(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")
    ranked = words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id())
    return stage(ranked.select("id", "word", "n"), "vocabulary")


def group_keys(words: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64 bits of the keys of non-empty words: of each word itself; and for each letter in turn, of the group without it
    but with its place, and of the word without it; and where that word is new (not the same as without the letter before)."""
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    place = (np.arange(len(c)) - start[owner]).astype(np.uint64)
    part = lambda at: mix64(mix64(c + np.uint64(seed)) + at * np.uint64(0x9E3779B97F4A7C15))
    here, left = part(place), part(place - np.uint64(1))  # a letter in its place, and moved to the left
    itself = np.add.reduceat(here, start)
    before = np.cumsum(here) - here
    after = np.cumsum(left[::-1])[::-1] - left
    ends = (start + size) % len(c)
    beyond = np.where(ends == 0, np.uint64(0), np.cumsum(left[::-1])[::-1][ends])  # sums run on over the words that follow
    replaced = itself[owner] - here + mix64(place + np.uint64(seed + 1))
    shorter = before - before[start][owner] + after - beyond[owner]
    new = np.append(True, c[1:] != c[:-1]) | (place == 0)
    return itself, replaced, shorter, new


def groups(words: DataFrame) -> DataFrame:
    """h1, h2, kind, id: a row for each group that a word is in."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("kind", pa.int32()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids, found = b.column(0).to_numpy(), b.column(1).to_pylist()
            (i1, r1, s1, new), (i2, r2, s2, _) = group_keys(found, 1), group_keys(found, 2)
            own = np.repeat(ids, [len(w) for w in found])
            for kind, h1, h2, at in ((_ITSELF, i1, i2, ids), (_REPLACED, r1, r2, own), (_DELETION, s1[new], s2[new], own[new])):
                for k in range(0, len(at), 1 << 16):
                    some = slice(k, k + (1 << 16))
                    yield batch(schema, h1[some].view(np.int64), h2[some].view(np.int64), np.full(len(at[some]), kind, np.int32), at[some])

    return words.select("id", "word").mapInArrow(lean(run), "h1 long, h2 long, kind int, id long")


def near(words: DataFrame) -> DataFrame:
    """id, n_near, best: how many words are near a word, and the smallest id of them.  Words without any are left out."""
    whole = Window.partitionBy("h1", "h2").orderBy("kind", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = groups(words).select(
        "kind", "id", F.count("*").over(whole).alias("size"), F.first("kind").over(whole).alias("lead"), F.first("id").over(whole).alias("top"), F.nth_value("id", 2).over(whole).alias("second")
    )
    deletion = F.col("kind") == _DELETION
    seen = seen.where((F.col("size") > 1) & ~(deletion & (F.col("lead") == _DELETION)))
    others = F.when(deletion, 1).otherwise(F.col("size") - 1)
    best = F.when(F.col("top") == F.col("id"), F.col("second")).otherwise(F.col("top"))
    return seen.select("id", others.alias("others"), best.alias("best")).groupBy("id").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(id, to): the last word that follows from each, by doubling.  links: a stage table of ids and the next ones."""
    while True:
        further = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        links = stage(links.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("id", "to")
        links = links.select("id", "to")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: for each word of ``min_chars`` code points and ``min_count`` occurrences the
    near word with the most, if it has ``ratio`` times as many, and the word at the end of that chain."""
    bound_batches(docs.sparkSession)
    words = vocabulary(occurrences(docs, min_chars), min_count)
    forms = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = words.join(near(words), "id", "left").join(forms, "best", "left")
    ok = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    known = stage(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(ok, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")
    roots = _roots(known.where("best is not null").select("id", F.col("best").alias("to")))
    last = words.select(F.col("id").alias("to"), F.col("word").alias("last"))
    out = known.join(roots.join(last, "to").select("id", "last"), "id", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
