"""Spelling variants against a plain loop over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from plumewire.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(plain, min_chars=7, min_count=2):
    found = Counter()
    for i, t in plain:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= min_chars and n >= min_count}


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(words, ratio=10):
    form, out = {}, []
    for w, n in words.items():
        near = [v for v in words if near_words(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out.append((w, n, len(near)))
    rows = []
    for w, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, k, words[form[w]] if form[w] else None))
    return sorted(rows)


def texts(seed=5, docs=60):
    """Frequent words, their misspellings, misspellings of those, letters beyond ASCII, doubled letters."""
    r = random.Random(seed)
    stems = ["aabbccdd", "handling", "Ärgerlich", "ÿÿÿÿÿÿÿÿ", "kaffeekanne", "passport", "ÀÀÀÀÀÀÀa", "international", "communication", "abcdefg"]
    letters = "abcdefghijéÿ×"

    def damaged(w):
        i = r.randrange(len(w))
        return {0: w[:i] + w[i + 1 :], 1: w[:i] + r.choice(letters) + w[i:], 2: w[:i] + r.choice(letters) + w[i + 1 :]}[r.randrange(3)]

    rows = []
    for k in range(docs):
        words = []
        for w in stems:
            words += [r.choice([w, w.lower(), w.upper()])] * r.randint(0, 12)
            for _ in range(2):
                words += [damaged(w)] * r.randint(0, 2)
            words += [damaged(damaged(w))]
        r.shuffle(words)
        rows.append((k, r.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, spelling.variants(table, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_against_all_pairs(spark):
    rows = [*texts(), (None, "handling handlinh passport"), (70, None), (71, ""), (72, " \n 12 "), (73, "x" * 3000 + " " + "x" * 2999), (74, "x" * 3000 + " " + "x" * 2999), (3, "handling"), (3, "handling"), (80, "chainword " * 400), (81, "chainwordx " * 30), (82, "chainwordxy " * 2)]
    want = brute_variants(brute_words(rows))
    assert len(want) > 300 and sum(w[1] is not None for w in want) > 50 and any(w[2] not in (w[0], w[1]) for w in want)
    assert run(spark, rows) == want


def test_ties_go_by_code_points(spark):
    """Two words with equally many occurrences are near a third."""
    whole = [k for k in range(200) if all(zlib.crc32(f"{k}:{w}".encode()) % 31 for w in ("tiebreakz", "tiebreaky", "tiebreakÿ", "tiebreak"))]
    rows = [(k, "tiebreakz tiebreaky tiebreakÿ " * 10) for k in whole[:40]] + [(k, "tiebreak") for k in whole[40:44]]
    want = brute_variants(brute_words(rows))
    assert run(spark, rows) == want
    assert {w[1] for w in want if w[0] == "tiebreak"} == {"tiebreaky"}


def test_empty_and_clashing_columns(spark, docs, plain):
    assert spelling.variants(docs.limit(0)).count() == 0
    got = sorted(map(tuple, spelling.variants(docs, min_chars=4, min_count=1).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute_variants(brute_words(plain, 4, 1))


def test_group_keys_are_those_of_the_strings():
    r = random.Random(2)
    words = ["".join(r.choice("aabé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    itself, replaced, shorter, new = spelling.group_keys(words, 1)
    at, seen = 0, {}
    same = lambda kind, value, key: seen.setdefault((kind, value), int(key)) == int(key)
    for w, whole in zip(words, itself):
        assert same("word", w, whole)
        for i in range(len(w)):
            assert same("group", (i, w[:i], w[i + 1 :]), replaced[at])
            if len(w) > 1:
                assert same("word", w[:i] + w[i + 1 :], shorter[at])
            assert new[at] == (i == 0 or w[i] != w[i - 1])
            at += 1
    assert len(set(seen.values())) == len(seen) and at == len(np.asarray(replaced))
