"""Quality rules as a short-circuit cascade.

Every rule needs some figures of a document (its words, its lines, counts of them), which are worked out when a rule
asks for them and then kept.  On a sample each figure's cost and each rule's rejections are measured, and the cascade is
put together step by step: the next rule is the one with the most rejections per second among the documents that are
still there, where only figures count that no earlier rule has asked for.  A document that one rule rejects is not shown
to the next.  The verdict does not depend on the order, only the time does.

The sample is at most ``SAMPLE_ROWS`` rows, chosen by a hash of the id from as many partitions as that takes, so a large
table is not read for it.

Defined results: a null or empty text has no words and fails the base rule; a very long text is judged whole; repeated
rows (ties) give repeated results; rules with equal figures are ordered by name; an empty table gives an empty result;
other columns of the input are ignored (``measure``) or kept untouched (``keep_good``).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, text_bytes

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
BULLETS = (b"-", b"*", "•".encode())
ELLIPSES = (b"...", "…".encode())
#: Rows of the cost sample.  Only the order of the rules depends on it.
SAMPLE_ROWS = 400
#: Bytes of the cost sample, at most.
SAMPLE_BYTES = 64 << 20


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, np.unique(twice)))
    mark = np.zeros(n, bool)
    mark[at] = mark[at + 1] = mark[at + 2] = True
    return int(mark.sum())


def _word_chars(v: View) -> int:
    return len(v.solid) if v.solid.isascii() else len(v.solid.decode("utf-8", "replace"))


#: What rules can ask for.  A figure may ask for others.
FIGURES: dict[str, Callable[[View], object]] = {
    "words": lambda v: v.body.split(),
    "solid": lambda v: v.body.translate(None, SPACE),
    "n_words": lambda v: len(v.words),
    "word_chars": _word_chars,
    "n_symbols": lambda v: len(v.solid) - len(v.solid.translate(None, SYMBOLS)),
    "lines": lambda v: [x for x in v.body.split(b"\n") if x.strip(SPACE)],
    "n_lines": lambda v: len(v.lines),
    "n_dup_lines": lambda v: len(v.lines) - len(set(v.lines)),
    "n_repeat_words": lambda v: repeated_words(v.words),
    "capitals": lambda v: len(v.body) - len(v.body.translate(None, UPPER)),
    "small_letters": lambda v: len(v.body) - len(v.body.translate(None, LOWER)),
    "vocabulary": lambda v: Counter(v.words),
    "n_letterless": lambda v: sum(not w.translate(None, NO_LETTERS) for w in v.words),
    "n_bullets": lambda v: sum(x.lstrip(SPACE).startswith(BULLETS) for x in v.lines),
    "n_ellipses": lambda v: sum(x.rstrip(SPACE).endswith(ELLIPSES) for x in v.lines),
}


class View:
    """One document as the rules see it: a figure is worked out when it is first asked for."""

    def __init__(self, body: bytes | None):
        self.body = body or b""

    def __getattr__(self, name: str):
        if name not in FIGURES:
            raise AttributeError(name)
        value = FIGURES[name](self)
        self.__dict__[name] = value
        return value


class Rule(NamedTuple):
    needs: tuple[str, ...]
    test: Callable[[View], bool]


#: The base contract's two rules.
BASE = {
    "few_words": Rule(("n_words",), lambda v: v.n_words < 50),
    "repeats": Rule(("n_words", "n_repeat_words"), lambda v: 100 * v.n_repeat_words > 50 * v.n_words),
}
#: More than three symbols for ten words; more capitals than small letters; more than half of the lines copies of an
#: earlier one; words of more than 40 characters on average; fewer than one distinct word in twenty; more than half of
#: the words without a letter; one word that is more than three in ten; nine in ten lines with a bullet; three in ten
#: lines that break off.
RULES = {
    "many_symbols": Rule(("n_symbols", "n_words"), lambda v: 10 * v.n_symbols > 3 * v.n_words),
    "shouting": Rule(("capitals", "small_letters"), lambda v: v.capitals > v.small_letters),
    "same_lines": Rule(("n_dup_lines", "n_lines"), lambda v: 2 * v.n_dup_lines > v.n_lines),
    "long_words": Rule(("word_chars", "n_words"), lambda v: v.word_chars > 40 * v.n_words),
    "small_vocabulary": Rule(("vocabulary", "n_words"), lambda v: 20 * len(v.vocabulary) < v.n_words),
    "few_letters": Rule(("n_letterless", "n_words"), lambda v: 2 * v.n_letterless > v.n_words),
    "one_word": Rule(("vocabulary", "n_words"), lambda v: 10 * max(v.vocabulary.values(), default=0) > 3 * v.n_words),
    "bullets": Rule(("n_bullets", "n_lines"), lambda v: 10 * v.n_bullets > 9 * v.n_lines),
    "breaking_off": Rule(("n_ellipses", "n_lines"), lambda v: 10 * v.n_ellipses > 3 * v.n_lines),
}
BASE_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(v: View) -> bool:
    return any(rule.test(v) for rule in BASE.values())


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[bytes]:
    """At most ``rows`` texts, chosen by a hash of the id; small tables are taken whole.  Texts
    longer than a row's share of ``most`` bytes are not in it, which bears on the order of the rules only."""
    text = docs.select("doc_id", F.col("text").cast("binary").alias("body")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most // rows)
    some = text.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(8)) == 0).select("body").limit(rows).collect()
    if len(some) < rows // 8:
        some = text.select("body").limit(rows).collect()
    return [bytes(r.body) if r.body is not None else b"" for r in some]


def figure_costs(bodies: list[bytes]) -> dict[str, float]:
    """Seconds a document for each figure on its own, the figures it asks for left out; the best of three runs."""
    costs: dict[str, list[float]] = {name: [] for name in FIGURES}
    for _ in range(3):
        views = [View(b) for b in bodies]
        for name, work in FIGURES.items():  # in an order in which a figure's own needs come first
            began = time.perf_counter()
            for v in views:
                v.__dict__[name] = work(v)
            costs[name].append(time.perf_counter() - began)
    return {name: max(min(c), 1e-9) / max(1, len(bodies)) for name, c in costs.items()}


_NEEDS = {"words": (), "solid": (), "n_words": ("words",), "word_chars": ("solid",), "n_symbols": ("solid",), "lines": (), "n_lines": ("lines",), "n_dup_lines": ("lines",), "n_repeat_words": ("words",), "vocabulary": ("words",), "n_letterless": ("words",), "n_bullets": ("lines",), "n_ellipses": ("lines",)}


def _asked(rule: Rule) -> set[str]:
    """The figures of a rule and those that they ask for."""
    return {x for n in rule.needs for x in (n, *_NEEDS.get(n, ()))}


def cascade(bodies: list[bytes], rules: dict[str, Rule], costs: dict[str, float], known: set[str] = frozenset()) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) in the order to run: each step takes the rule with the most
    rejections per second among the documents that passed the steps before; ties by name.  ``known``: figures that are
    there already."""
    left, views, done, out = dict(rules), [View(b) for b in bodies], set(known), []
    while left:
        rated = []
        for name, rule in left.items():
            cost = 1e-7 + sum(costs[f] for f in _asked(rule) - done)
            share = (sum(map(rule.test, views)) + 0.5) / (len(views) + 1)  # a rule that hit nothing may still hit later
            rated.append((-share / cost, name, cost, share))
        _, name, cost, share = min(rated)
        rule = left.pop(name)
        done |= _asked(rule)
        views = [v for v in views if not rule.test(v)]
        out.append((name, cost, share))
    return out


def estimate(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS, known: set[str] = frozenset()) -> list[tuple[str, float, float]]:
    """``cascade`` on a sample of ``docs``."""
    bodies = sample(docs, sample_rows)
    return cascade(bodies, rules, figure_costs(bodies), known)


def measure(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and rejected_by (the first rule that fired; depends on the order).
    The base figures are returned, so they cost the cascade nothing."""
    bound_batches(docs.sparkSession)
    known = {x for f in BASE_FIGURES for x in (f, *_NEEDS[f])}
    steps = [(name, rules[name].test) for name in (order or [e[0] for e in estimate(docs, rules, known=known)])]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE_FIGURES), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for body in b.column(1).to_pylist():
                v = View(body)
                figures = [getattr(v, f) for f in BASE_FIGURES]
                failed = base_failed(v)
                by = "base" if failed else next((name for name, test in steps if test(v)), None)
                rows.append((*figures, failed, by is None, by))
            yield batch(arrow, b.column(0), *(zip(*rows) if rows else [[]] * 8))

    return text_bytes(docs).mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """The input rows that pass, with their own columns.  The base rules take part in the cascade, figures are worked
    out only as far as a document gets, the text goes through Python once and nothing is shuffled."""
    bound_batches(docs.sparkSession)
    every = BASE | rules
    steps = [every[name].test for name in ([*BASE, *order] if order else [e[0] for e in estimate(docs, every)])]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = map(View, b.column(at).cast(pa.binary()).to_pylist())
            yield b.filter(pa.array([not any(test(v) for test in steps) for v in views], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
