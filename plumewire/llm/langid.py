"""Language identification with interpolated Kneser-Ney character models.

A text is its lower-cased words (runs of non-ASCII characters and ASCII letters), each between two blanks.  Each
language has a Kneser-Ney model of order ``ORDER`` over the characters of such words.  The models are kept as
sorted arrays of n-gram hashes with one column of log probabilities a language, and of context hashes with the
back-off weights.  The language with the lowest cross-entropy a character wins; ties go to the first name.

The models learn from at most about ``max_docs`` labelled texts a language, chosen by hash.  A fifth of them is
held back to calibrate: the temperature of the score, and for each language the cross-entropy beyond which a
prediction is marked as rejected.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any language learned all
texts are ``und``; a very long text is scored whole; repeated rows give repeated results; a null doc_id is kept as it is;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, mix64

ORDER, MAX_DOCS = 5, 400
#: Bytes of text that a language is learned from, at most; languages, at most (those that most texts have).
MAX_BYTES, MAX_LANGS = 64 << 20, 256
#: Share of a language's own texts that its rejection threshold lets pass.
ACCEPT = 0.995
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, or none if the text has no letter."""
    if not text:
        return []
    words = text.lower().encode().translate(_TABLE).split()
    if words and not any(w[0] < 128 for w in words) and not any(map(str.isalpha, text)):
        return []
    return words


def _windows(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Over all predicted characters of ``words``: the word's row, the character, the context length at hand and
    the hashes of the contexts of each length below ``order``."""
    text = "".join(" " + w.decode("utf-8", "replace") + " " for w in words)
    code = np.array([ord(c) for c in text], np.uint64) if not text.isascii() else np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    length = np.array([len(w.decode("utf-8", "replace")) + 2 for w in words])
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(code)) - start[row]
    at = np.flatnonzero(place > 0)
    contexts = [np.zeros(len(at), np.uint64)]
    h = np.zeros(len(at), np.uint64)
    for k in range(1, order):
        ok = place[at] >= k
        h = np.where(ok, mix64(h + code[np.maximum(at - k, 0)] + np.uint64(1) + np.uint64(k << 32)), np.uint64(0))
        contexts.append(h)
    return row[at], code[at], np.minimum(place[at], order - 1), contexts


def _gram(context: np.ndarray, char: np.ndarray) -> np.ndarray:
    return mix64(context ^ (char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Models:
    """Sorted hash arrays with a column for each language."""

    def __init__(self, langs: list[str], counts: list[Counter], order: int = ORDER):
        self.langs, self.order = langs, order
        self.grams, self.logs, self.contexts, self.backs = [], [], [], []
        self.temperature, self.limits = 1.0, np.full(len(langs), np.inf)
        data = []
        for c in counts:
            words = sorted(c)
            row, char, known, contexts = _windows(words, order) if words else (np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), [np.zeros(0, np.uint64)] * order)
            data.append((np.array([c[w] for w in words], float)[row] if words else np.zeros(0), char, known, contexts))
        self.cut = {}
        for k in range(1, order):  # the context one character shorter
            pairs = [(d[3][k][d[2] >= k], d[3][k - 1][d[2] >= k]) for d in data]
            longer, first = np.unique(np.concatenate([x for x, _ in pairs]), return_index=True)
            self.cut[k] = (longer, np.concatenate([y for _, y in pairs])[first])
        self.alphabet = len({int(x) for d in data for x in np.unique(d[1])}) + 1
        for k in range(order):
            self._level(k, data)
        self.cut = {}

    def _level(self, k: int, data: list) -> None:
        """Order k + 1: raw counts at the highest order, and where a context is at its word's start; below, the
        number of distinct characters before the n-gram."""
        found = []
        for weight, char, known, contexts in data:
            ok = known >= k
            context, c = contexts[k][ok], char[ok]
            gram = _gram(context, c)
            if k < self.order - 1:
                # distinct longer n-grams; where the word starts there is no longer one, and the raw count stands in
                longer = known[ok] > k
                wide = _gram(contexts[k + 1][ok], c)
                _, one = np.unique(wide[longer], return_index=True)
                use = np.concatenate((np.flatnonzero(longer)[one], np.flatnonzero(~longer)))
                amount = np.concatenate((np.ones(len(one)), weight[ok][~longer]))
            else:
                use, amount = np.arange(len(gram)), weight[ok]
            g, first, inverse = np.unique(gram[use], return_index=True, return_inverse=True)
            n = np.bincount(inverse, amount, len(g))
            found.append((g, context[use][first], c[use][first], n))
        every, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        context = np.concatenate([f[1] for f in found])[first]
        char = np.concatenate([f[2] for f in found])[first]
        names = np.unique(context)
        place = np.searchsorted(names, context)
        logs, backs = np.zeros((len(every), len(found))), np.zeros((len(names), len(found)))
        lower = self._lower(k, context, char)
        for i, (g, _, _, n) in enumerate(found):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            count = np.zeros(len(every))
            count[np.searchsorted(every, g)] = n
            total = np.bincount(place, count, len(names))
            kinds = np.bincount(place, count > 0, len(names))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
            own = np.where(count > 0, count - discount, 0) / np.maximum(total[place], 1e-300)
            logs[:, i] = np.log(np.maximum(own + back[place] * lower[:, i], 1e-300))
            backs[:, i] = np.log(back)
        self.grams.append(every)
        self.logs.append(logs.astype(np.float32))
        self.contexts.append(names)
        self.backs.append(backs.astype(np.float32))

    def _lower(self, k: int, context: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Probabilities of the next lower order for n-grams of this one."""
        if k == 0:
            return np.full((len(char), len(self.langs)), 1.0 / self.alphabet)
        longer, short = self.cut[k]
        short = short[np.searchsorted(longer, context)]
        at, hit = _find(self.grams[k - 1], _gram(short, char))
        out = np.where(hit[:, None], self.logs[k - 1][at] if len(self.grams[k - 1]) else 0.0, -np.log(self.alphabet))
        return np.exp(out)

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log probability in each language, and its predicted characters."""
        row, char, known, contexts = _windows(words, self.order)
        total = np.zeros((len(char), len(self.langs)), np.float32)
        todo = np.ones(len(char), bool)
        for k in range(self.order - 1, -1, -1):
            try_ = np.flatnonzero(todo & (known >= k))
            at, hit = _find(self.grams[k], _gram(contexts[k][try_], char[try_]))
            total[try_[hit]] += self.logs[k][at[hit]]
            todo[try_[hit]] = False
            miss = try_[~hit]
            at, hit = _find(self.contexts[k], contexts[k][miss])
            total[miss[hit]] += self.backs[k][at[hit]]
        total[todo] += np.float32(-np.log(self.alphabet))
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, row, total)
        return out, np.bincount(row, minlength=len(words))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Scorer:
    """Cross-entropy of texts; words seen before are looked up."""

    def __init__(self, models: Models, room: int = 600_000):
        self.models, self.room = models, room
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 12, len(self.models.langs) + 1))

    def entropies(self, docs: list[list[bytes]]) -> np.ndarray:
        """nan for a text without words."""
        if len(self.row) > self.room:
            self.clear()
        new = list(set().union(*docs) - self.row.keys()) if docs else []
        if new:
            logs, chars = self.models.score(new)
            n = len(self.row)
            while n + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores, self.scores))
            self.scores[n : n + len(new)] = np.column_stack((logs, chars))
            self.row.update(zip(new, range(n, n + len(new))))
        get = self.row.__getitem__
        sums = [self.scores[np.fromiter(map(get, d), np.int64, len(d))].sum(axis=0) if d else np.full(len(self.models.langs) + 1, np.nan) for d in docs]
        got = np.array(sums).reshape(len(docs), -1)
        return -got[:, :-1] / got[:, -1:]


def _posterior(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropy * temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, use: Column, max_docs: int = MAX_DOCS, order: int = ORDER, max_bytes: int = MAX_BYTES, max_langs: int = MAX_LANGS) -> Models | None:
    """Models from the rows of ``docs`` (text, lang) for which ``use`` holds and the language is known: about ``max_docs``
    texts of each of the ``max_langs`` languages that most texts have, the first ``max_bytes`` of a language in the order of
    a hash (a text that is longer than a sixteenth of that is left out)."""
    labelled = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not sizes:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / n))) for lang, n in sizes.items()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_003)) / 1_000_003.0
    some = labelled.where((draw < share) & (F.octet_length("text") <= max_bytes // 16)).select("lang", "text", "doc_id", F.octet_length("text").alias("bytes"))
    so_far = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(31)), F.xxhash64("text"))  # about max_docs rows
    within = some.withColumn("bytes", F.sum("bytes").over(so_far)).where(F.col("bytes") <= max_bytes)
    rows = within.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(5)) == 0).alias("held")).collect()  # at most max_bytes a language
    fitted: dict[str, Counter] = {lang: Counter() for lang in sizes}
    inner: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for r in rows:
        fitted[r.lang].update(words_of(r.text))
        if not r.held:
            inner[r.lang].update(words_of(r.text))
    langs = sorted(x for x in sizes if fitted[x])
    if not langs:
        return None
    models = Models(langs, [fitted[x] for x in langs], order)
    # Temperature and thresholds come from held texts, of the languages that have words without them.
    tried = [x for x in langs if inner[x]]
    held = [(tried.index(r.lang), words) for r in sorted(rows, key=lambda r: (r.lang, r.text)) if r.held and r.lang in tried and (words := words_of(r.text))]
    if held:
        entropy = Scorer(Models(tried, [inner[x] for x in tried], order)).entropies([w for _, w in held])
        truth = np.array([i for i, _ in held])
        own = np.arange(len(truth))
        losses = {t: -np.log(np.maximum(_posterior(entropy, t)[own, truth], 1e-9)).mean() for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
        models.temperature = min(losses, key=lambda t: (losses[t], t))
        known = {x: np.quantile(e, ACCEPT) * 1.05 for i, x in enumerate(tried) if len(e := entropy[own, truth][truth == i])}
        models.limits = np.array([known.get(x, np.inf) for x in langs])
    return models


_scorers: dict[str, Scorer] = {}


def forget_scorers() -> None:
    _scorers.clear()


def scorer(key: str, models: Models) -> Scorer:
    """The worker's scorer; tasks of one job share it."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(models)
    return _scorers[key]


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the prediction), entropy, rejected."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(models)  # its size follows from max_docs
    name = uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            docs_ = [words_of(t) for t in b.column(1).cast(pa.string()).to_pylist()]
            if m is None:
                yield batch(schema, b.column(0), ["und"] * len(docs_), [0.0] * len(docs_), [None] * len(docs_), [True] * len(docs_))
                continue
            entropy = scorer(name, m).entropies(docs_)
            some = ~np.isnan(entropy[:, 0])
            safe = np.where(some[:, None], entropy, 0.0)
            best = safe.argmin(axis=1)
            at = np.arange(len(docs_))
            score = _posterior(safe, m.temperature)[at, best]
            found = [m.langs[i] if ok else "und" for i, ok in zip(best.tolist(), some.tolist())]
            yield batch(schema, b.column(0), found, np.where(some, score, 0.0), [float(e) if ok else None for e, ok in zip(safe[at, best], some)], ~some | (safe[at, best] > m.limits[best]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(lean(run, "languages", forget_scorers), "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
