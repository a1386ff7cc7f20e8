"""Soft-membership mixing of sources to target weights, in DataFrame operations only.

A classifier learned from a table of labelled documents gives each document a posterior over domains
(Bernoulli naive Bayes over a bounded vocabulary).  Projected-gradient least squares then fits one nonnegative
rate for each document, so that the expected tokens of each domain, ``sum(rate * tokens * posterior)``, meet the
targets.  An iteration is one aggregate over (tokens, posterior); the rates are never gathered, they follow
from the few step vectors so far.

Bounds (parameters): the classifier learns from at most about ``max_rows`` labelled rows, chosen by hash, and
keeps ``vocabulary`` words.  Token totals, gradients and rates cover all documents.

Defined results: a null or empty text has no tokens, the posterior of a document without known words, and a rate
like others; labels with a null domain or doc_id are left out; several labels of one document: the smallest
domain; without labels there is one domain, ``all``; an empty table gives an empty result; repeated rows are
documents of their own; a very long text is one document with all its words; equal words in the vocabulary's order are
taken by name (ties); other columns are ignored (``rates``) or kept untouched (``mix``).
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROWS, VOCABULARY, MIN_SUPPORT, MIN_LIFT = 20_000, 256, 5, 2.0
STEPS, TOLERANCE = 60, 1e-4
#: Standard deviations that a word's count in some domain must exceed the expected one by.
MIN_Z = 5.0
#: Share of all tokens below which a domain's residual no longer gains weight.
FLOOR = 0.01


def words(text: Column) -> Column:
    """Distinct lower-case words, and one mark for the share of symbol characters."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>!]+", ""))
    marks = F.concat(F.lit("#symbols"), F.least(F.lit(9), F.floor(F.lit(20) * symbols / F.greatest(F.length(text), F.lit(1)))).cast("string"))
    return F.array_append(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), marks)


@dataclass
class Classifier:
    domains: list[str]
    base: list[float]  # log prior plus the log chance of no known word at all
    weights: dict[str, list[float]] = field(default_factory=dict)

    def unmarked(self) -> list[float]:
        """The posterior of a document without any known word."""
        grown = [math.exp(b - max(self.base)) for b in self.base]
        return [g / sum(grown) for g in grown]

    def posterior(self, text: Column) -> Column:
        """array<double> in the order of ``domains``; no shuffle, the model is a literal."""
        scores = F.array(*map(F.lit, self.base))
        if self.weights:
            names = sorted(self.weights)
            known = F.array_intersect(words(text), F.array(*map(F.lit, names)))
            table = F.create_map(*(x for w in names for x in (F.lit(w), F.array(*map(F.lit, self.weights[w])))))
            scores = F.aggregate(known, scores, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
        return _normal(scores)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _normal(scores: Column) -> Column:
    grown = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return _let(_let(scores, grown), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY, min_support: int = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> Classifier:
    """labels: doc_id, domain.  Words count that mark a domain of at most two thirds of the documents: it holds ``min_lift``
    times as many of the word's documents as of all, and ``MIN_Z`` standard deviations more; common words would only tell long texts from short ones.  A word's support counts families of near copies (documents with one smallest
    hash of three words), not documents, so a text that was copied often does not vouch for its own words."""
    given = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = given.count()
    part = min(1.0, max_rows / max(n, 1))
    chosen = given.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * part) + (part == 1.0))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about max_rows small rows
    run = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.size("run") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("run", i), F.get("run", i + 1), F.get("run", i + 2)))
    held = some.withColumn("run", run).select("domain", words(F.col("text")).alias("words"), F.array_min(triples).alias("family"))
    held = stage(held, "labelled")
    sizes = {r.domain: r.n for r in held.groupBy("domain").agg(F.count_distinct("family").alias("n")).collect()}
    if not sizes:
        return Classifier(["all"], [0.0])
    domains = sorted(sizes)
    counted = held.select("domain", "family", F.explode("words").alias("word")).where("word <> ''").distinct().groupBy("word")
    counted = counted.agg(*(F.sum((F.col("domain") == d).cast("int")).alias(f"c{i}") for i, d in enumerate(domains)))
    total = sum(sizes.values())
    rate = [(F.col(f"c{i}") + 0.5) / (sizes[d] + 1) for i, d in enumerate(domains)]
    support = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))
    # Mutual information between the word and the domain, as far as the word's presence goes.
    share = support / total
    # Markers of a domain: its share of the word's documents is min_lift times its share of all, or nine in ten.
    marks = F.lit(False)
    for i, d in enumerate(domains):
        part = sizes[d] / total
        if part <= 2 / 3:
            clear = (F.col(f"c{i}") - support * part) / F.sqrt(support * part + 0.5) >= MIN_Z
            marks = marks | (F.col(f"c{i}") / support >= min(min_lift * part, 0.9)) & clear
    gain = sum((F.lit(sizes[d] / total) * rate[i] * F.log(rate[i] / share) for i, d in enumerate(domains)), F.lit(0.0))
    best = counted.where((support >= min_support) & marks).withColumn("gain", F.round(gain, 9)).orderBy(F.desc("gain"), "word").limit(vocabulary).collect()
    base = [math.log(sizes[d] / total) for d in domains]
    weights = {}
    for r in best:
        p = [(r[f"c{i}"] + 0.5) / (sizes[d] + 1) for i, d in enumerate(domains)]
        weights[r.word] = [math.log(x / (1 - x)) for x in p]
        base = [b + math.log(1 - x) for b, x in zip(base, p)]
    return Classifier(domains, base, weights)


def members(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens, posterior of every document."""
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", tokens.alias("tokens"), model.posterior(F.col("text")).alias("posterior"))


def membership(posterior: Column, rest: list[float]) -> Column:
    """The posterior as far as it stands out from ``rest``, that of a document without any marker; what doesn't belong to
    another domain belongs to the largest one, so that a document without markers is wholly in that one."""
    main = max(range(len(rest)), key=lambda i: rest[i])
    out = lambda p, i: F.greatest(F.lit(0.0), p[i] - rest[i]) / max(1e-9, 1 - rest[i])
    others = lambda p: [out(p, i) for i in range(len(rest)) if i != main]
    own = lambda p: F.greatest(F.lit(0.0), F.lit(1.0) - sum(others(p), F.lit(0.0)))
    return _let(posterior, lambda p: F.array(*(own(p) if i == main else out(p, i) for i in range(len(rest)))))


def rate_after(steps: list[list[float]], posterior: Column, most: float = math.inf) -> Column:
    """The rate after the projected steps so far, from 1; between 0 and ``most``."""
    if not steps:
        return F.lit(1.0)
    k = len(steps[0])
    taken = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    move = lambda p, c: sum((p[i] * c[i] for i in range(1, k)), p[0] * c[0])
    held = (lambda r: r) if math.isinf(most) else (lambda r: F.least(F.lit(float(most)), r))
    return _let(posterior, lambda p: F.aggregate(taken, F.lit(1.0), lambda r, c: held(F.greatest(F.lit(0.0), r - move(p, c)))))


def fit(held: DataFrame, targets: dict[int, float], steps: int = STEPS, tolerance: float = TOLERANCE, most: float = math.inf) -> list[list[float]]:
    """Step vectors of the projected gradient descent on ``sum_k (T_k - target_k)**2 / scale_k`` over rates >= 0.
    ``held`` has tokens and posterior; ``targets`` gives tokens for (some) places of the posterior.  A descent that is
    still moving after ``steps`` steps warns, and says by how much the targets are missed."""
    first = held.select(F.size("posterior").alias("k")).first()
    if first is None:
        return []
    k = first.k
    p = [F.col("posterior")[i] for i in range(k)]
    n = F.col("tokens").cast("double")
    gram = held.agg(F.sum(n).alias("n"), *(F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    if not gram.n:
        return []
    scale = {i: max(gram[f"g{i}_{i}"], FLOOR * gram.n) for i in targets}
    entry = lambda i, j: gram[f"g{max(i, j)}_{min(i, j)}"] / math.sqrt(scale[i] * scale[j])
    bound = max(sum(abs(entry(i, j)) for j in targets) for i in targets)  # at least the largest eigenvalue
    taken: list[list[float]] = []
    last: dict[int, float] = {}
    settled = False
    for _ in range(steps):
        r = rate_after(taken, F.col("posterior"), most)
        now = held.select(r.alias("r"), "tokens", "posterior").agg(*(F.sum(F.col("r") * n * p[i]).alias(f"t{i}") for i in targets)).first()
        miss = {i: now[f"t{i}"] - t for i, t in targets.items()}
        if max(abs(m) for m in miss.values()) <= tolerance * gram.n or last and max(abs(miss[i] - last[i]) for i in miss) <= tolerance * gram.n / 10:
            settled = True  # met, or as near as nonnegative rates come
            break
        last = miss
        taken.append([miss[i] / scale[i] / bound if i in miss else 0.0 for i in range(k)])
    if not settled:
        warnings.warn(f"the rates have not settled after {steps} steps; expected tokens miss the targets by {last}", stacklevel=2)
    return taken


def draw(doc_id: Column, rate: Column, seed: int = 7) -> Column:
    """Copies of a document: the rate rounded up or down by chance, the chance being a hash of its id."""
    u = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return F.floor(rate + u).cast("long")


def present(held: DataFrame, model: Classifier) -> dict[str, float]:
    """Expected tokens of each domain as the collection is."""
    got = held.agg(*(F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(len(model.domains)))).first()
    return {d: got[f"t{i}"] or 0.0 for i, d in enumerate(model.domains)}


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, tokens, posterior and domains, rate, copies: the total stays as it is, the domains get the shares ``weights``."""
    model = learn(docs, labels)
    held = stage(members(docs, model), "members")
    total = sum(present(held, model).values())
    sum_ = sum(weights.values())
    targets = {i: total * weights[d] / sum_ for i, d in enumerate(model.domains) if d in weights}
    taken = fit(held, targets) if targets else []
    rate = rate_after(taken, F.col("posterior"))
    return held.select("doc_id", "tokens", F.array(*map(F.lit, model.domains)).alias("domains"), "posterior", rate.alias("rate"), draw(F.col("doc_id"), rate).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, factors: dict[str, float]) -> DataFrame:
    """The input rows, each as often as its rate says: rates below one drop rows by chance, rates above one give copies.
    Each domain of ``factors`` is to have so many times the expected tokens that it has now (its epochs).  A domain
    that is to shrink shrinks by what stands out from documents without any marker, so that a classifier that can tell
    nothing drops nothing.

    Rows without a doc_id stay as they are; other columns are kept; an empty table stays empty."""
    model = learn(docs, labels)
    held = stage(members(docs, model), "members")
    now = present(held, model)
    rest = model.unmarked()
    same = held.agg(*(F.sum(F.col("tokens") * F.least(F.col("posterior")[i], F.lit(rest[i]))).alias(f"t{i}") for i in range(len(rest)))).first()
    floor = {d: (same[f"t{i}"] or 0.0) if factors.get(d, 1.0) < 1 else 0.0 for i, d in enumerate(model.domains)}
    targets = {i: floor[d] + (now[d] - floor[d]) * factors[d] for i, d in enumerate(model.domains) if d in factors}
    taken = fit(held, targets) if targets else []
    times = F.when(F.col("doc_id").isNull(), F.lit(1).cast("long")).otherwise(draw(F.col("doc_id"), rate_after(taken, model.posterior(F.col("text")))))
    name = "__pw_times"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, times).where(F.col(name) > 0)
    return out.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).drop(name)


def blend(docs: DataFrame, labels: DataFrame, weights: dict[str, float], whole: str, most: float = 1.0) -> DataFrame:
    """The input rows, each as often as its fitted rate says, so that the domains come as near to the shares ``weights`` of
    the expected tokens as rates up to ``most`` allow.  The total is the one at which the domain ``whole`` keeps the tokens
    that it has.  Memberships are those of ``membership``: a classifier that can tell nothing drops nothing.

    Rows without a doc_id stay as they are; other columns are kept; an empty table stays empty; domains that no label has
    don't count, and without ``whole`` among the labels every row stays."""
    model = learn(docs, labels)
    if whole not in model.domains or not weights.get(whole):
        return docs
    rest = model.unmarked()
    soft = members(docs, model)
    held = stage(soft.select("doc_id", "tokens", membership(F.col("posterior"), rest).alias("posterior")), "members")
    total = present(held, model)[whole] / weights[whole]
    targets = {i: total * weights[d] for i, d in enumerate(model.domains) if d in weights}
    rate = rate_after(fit(held, targets, most=most), membership(model.posterior(F.col("text")), rest), most)
    times = F.when(F.col("doc_id").isNull(), F.lit(1).cast("long")).otherwise(draw(F.col("doc_id"), rate))
    name = "__pw_times"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, times).where(F.col(name) > 0)
    return out.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).drop(name)


def quality_domains(labels: DataFrame) -> DataFrame:
    """The domain of a labelled document: toxic, low or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
