"""MinHash near-dedup with tensored banding.

A document's set is its distinct ``width``-word shingles.  Two small collections of half keys (``rows``
minhashes each) are computed; every pair of a half key of one collection and a half key of the other is the key
of a table, so ``side * side`` tables cost ``2 * side * rows`` minhashes instead of ``2 * side * side * rows``.
A pair with similarity s meets in some table with probability (1 - (1 - s**rows)**side)**2: 0.9994 at 0.8 for
the defaults.  Every candidate link is confirmed on the full sets.

Copies (equal sets) are one class from the start.  In each bucket every class is compared with the smallest
one.  Links inside a component need no further test; what is left are buckets whose classes lie in different
components.  Small ones are compared pair by pair.  The classes of large ones meet again by the rarest shingles of
their sets: sets of similarity t share one of their first n - ceil(t * n) + 1 shingles in any fixed order, and with the
rare ones first a common passage makes nobody meet.  Where many classes share a rare shingle too, they are compared in
pairs of bounded blocks, which give back links and not candidates.  So no candidate is dropped.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer
words than ``width`` is one shingle; a very long text is one set of all its shingles; repeated rows and ties are
copies; rows with a null doc_id are linked like others and get the class's component, or null when alone; an empty
table gives an empty result; other columns are ignored (``cluster``) or kept untouched (``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, by_ids, lean, mix64, shuffle_width, stage, text_bytes

WIDTH, PERCENT = 5, 80
SIDE, ROWS = 8, 2
#: Buckets of at most so many classes are compared pair by pair; larger ones in blocks of about so many shingles.
SMALL, BLOCK = 24, 200_000
#: Cells of the table of shingle frequencies that orders the shingles of a set; its size is fixed.
CELLS = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHash(dict):
    """64-bit word hashes, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000 and len(word) < 40:
            self[word] = value
        return value


_words = _WordHash()


def forget_words() -> None:
    _words.clear()


def shingle_set(body: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; A-Z count as a-z."""
    words = body.lower().split() if body else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    m = n - width + 1
    s = np.zeros(m, np.uint64)
    for i in range(width):
        s = mix64(s + h[i : i + m] * _ODD[i % 8] + np.uint64(i))
    return np.unique(s)


def half_keys(shingles: np.ndarray, side: int = SIDE, rows: int = ROWS) -> np.ndarray:
    """The ``2 * side`` half keys of a set, each from ``rows`` minhashes."""
    count = 2 * side * rows
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = max(1, 200_000 // count)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), step):
        part = shingles[i : i + step, None] ^ seeds
        part = (part * np.uint64(0x9E3779B97F4A7C15)) ^ (part >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, part.min(axis=0), out=least)
    out = np.zeros(2 * side, np.uint64)
    for r in range(rows):
        out = mix64(out + least.reshape(2 * side, rows)[:, r] * _ODD[r % 8] + np.uint64(r + 1))
    return out


def signatures(docs: DataFrame, width: int = WIDTH, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set (null if empty), and the two collections of half keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for body in b.column(1).to_pylist():
                s = shingle_set(body, width)
                keys = half_keys(s, side, rows).view(np.int64) if len(s) else np.empty(0, np.int64)
                for to, x in zip(out, (len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, keys[:side], keys[side:])):
                    to.append(x)
            yield batch(schema, b.column(0), *out)

    return text_bytes(docs).mapInArrow(lean(run, "words", forget_words), "doc_id long, n_shingles long, digest binary, left array<long>, right array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, class, size) for each table: a key joins the table's place with one half key of each collection."""
    both = F.flatten(F.transform("left", lambda a, i: F.transform("right", lambda b, j: F.xxhash64(i, j, a, b))))
    return classes.select(F.explode(both).alias("key"), "rep", "n")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep and its full shingle set, for the representatives that stand in a bucket with others."""
    schema = pa.schema([("rep", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), [shingle_set(x, width).tobytes() for x in b.column(1).to_pylist()])

    return by_ids(text_bytes(docs), stage(wanted.withColumnRenamed("rep", "doc_id"), "wanted"), "left_semi").mapInArrow(lean(run, "words", forget_words), "rep long, items binary")


def _meet(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key).  A key with many rows is dealt over several tasks by ``spread``,
    and its fact is copied as often.  rows: a stage table."""
    limit = max(64, rows.count() // (2 * shuffle_width(rows.sparkSession)))
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    hot = F.broadcast(stage(hot, "hot"))  # at most (all rows) / limit keys
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("salts")
    copied = facts.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  pairs: a stage table."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield batch(schema, t.column(0).filter(keep), t.column(1).filter(keep))

    first = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    # Candidates of one class are met by its set first, on whichever side there are many of them.
    return _meet(pairs, second, "b", "a").join(first, "a").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _with_least(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): each edge with the least neighbour of its u; and (u, m) alone.  Nodes with more than ``limit`` edges,
    of which there are few, meet their edges by a broadcast, so that the edges of no node are one task's."""
    found = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = found.select("u", "m")
    hot = F.broadcast(found.where(F.col("n") > limit).select("u", "m"))  # at most (all edges) / limit
    cold = edges.join(hot.select("u"), "u", "left_anti").join(found.where(F.col("n") <= limit).select("u", "m"), "u")
    return cold.unionByName(edges.join(hot, "u")), least


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; the label is the smallest node of its component.

    Alternates two steps until nothing changes: larger neighbours of a node are tied to its smallest
    neighbour, then the smaller ones.  Minima come from partial aggregates, and nodes with many edges are joined apart,
    so a star with very many leaves is no single task."""
    width = shuffle_width(edges.sparkSession)
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n, seen = now.count(), None
    while True:
        limit = max(32, n // (2 * width))  # so at most 4 * width nodes are hot
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tied, _ = _with_least(both, limit)
        large = tied.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        tied, least = _with_least(large, limit)
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (state.n, state.s):
            break
        seen, n = (state.n, state.s), state.n
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def cluster(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id = component_id)."""
    bound_batches(docs.sparkSession)
    signed = stage(signatures(docs, width, side, rows), "signatures")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    classes = stage(classes, "classes")
    labels = _link(docs, classes, width, percent)
    named = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _link(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    keys = table_keys(classes)
    pivots = keys.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("rep", "n")).alias("pivot")).where("many > 1")
    buckets = stage(keys.join(pivots, "key").select("key", "rep", "n", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "buckets")
    near = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    tested = stage(buckets.where((F.col("rep") != F.col("pivot")) & near).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    sets = stage(_sets(docs, buckets.select("rep").distinct(), width), "sets")
    edges = stage(_confirm(tested, sets, percent), "links")
    labels = stage(components(edges), "labels")
    # What is left to test: classes of one bucket in different components.
    left = buckets.where("rep <> pivot").select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = left.groupBy("key").agg(F.count("*").alias("many"), F.min("rep").alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "many", "head")
    left = stage(left.join(mixed, "key"), "left")
    small = _pairs(left.where(f"many <= {SMALL}"), "key", percent)
    large = left.where(f"many > {SMALL}").select("rep", "label").distinct()
    pairs, rest = small, None
    if not large.isEmpty():
        prefixes = stage(_prefixes(stage(large.join(sets, "rep"), "large"), percent), "prefixes")
        shared = prefixes.groupBy("key").agg(F.count("*").alias("many"), F.min("rep").alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("many > 1 and lo <> hi")
        again = prefixes.join(shared.select("key", "many", "head"), "key")
        pairs = pairs.unionByName(_pairs(again.where(f"many <= {SMALL}"), "key", percent)).distinct()
        rest = stage(again.where(f"many > {SMALL}").select("rep", "head").distinct(), "rest")
    confirmed = _confirm(stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs"), sets, percent)
    found = stage(confirmed if rest is None or rest.isEmpty() else confirmed.unionByName(_resolve(rest, sets, percent)), "links")
    if found.isEmpty():
        return labels
    ties = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found)
    return stage(components(ties), "labels")


def _pairs(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """(a, b) with a > b for classes of one key in different components, where the sizes allow a link.
    rows: key, rep, n, label; a key has at most SMALL of them."""
    other = rows.select(key, F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"))
    near = (F.col("label") != F.col("bl")) & (100 * F.least("n", "bn") >= percent * F.greatest("n", "bn")) & (F.col("rep") > F.col("b"))
    return rows.join(other, key).where(near).select(F.col("rep").alias("a"), "b").distinct()


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, label): the shingles of each set that it must share one of with any set similar enough, the rarest
    ones first.  How frequent a shingle is comes from a table of ``CELLS`` counts, where some share a cell: the order is
    the same for all sets, which is all that matters for the result.  members: rep, label, items."""
    cell = lambda s: (s & np.uint64(CELLS - 1)).astype(np.int64)
    tally = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                np.add.at(total, cell(np.frombuffer(x, np.uint64)), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield batch(tally, at[i : i + (1 << 16)].astype(np.int32), total[at[i : i + (1 << 16)]])

    counted = members.select("items").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    table = np.zeros(CELLS, np.int64)
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    held = members.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("label", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, label, raw in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(raw, np.uint64)
                n = len(s)
                first = s[np.lexsort((s, held.value[cell(s)]))][: n - -(-percent * n // 100) + 1]
                yield batch(schema, first.view(np.int64), *(np.full(len(first), x, np.int64) for x in (rep, n, label)))

    return members.select("rep", "label", "items").mapInArrow(lean(run), "key long, rep long, n long, label long")


def _resolve(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of large groups.  Groups that share classes form a team; its classes are dealt into blocks
    of bounded size, and each pair of blocks is one task, which counts common shingles over an inverted index and gives
    back a spanning set of links only.  large: rep, head (the smallest class of its group)."""
    groups = components(large.select(F.col("rep").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("rep"), F.col("label").alias("team"))
    heads = groups.select(F.col("team").alias("rep"), "team").distinct()
    members = stage(groups.unionByName(heads).join(sets, "rep"), "members")
    blocks = members.groupBy("team").agg(F.ceil(F.sum(F.length("items")) / (8 * BLOCK)).cast("int").alias("blocks"))
    dealt = _meet(members, blocks, "team", "rep").withColumn("x", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("team", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "rep", "items")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_pylist()
        sets_ = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        block, j = np.array(table["x"].to_pylist()), table["j"][0].as_py()
        size = np.array([len(x) for x in sets_])
        _, shingle = np.unique(np.concatenate(sets_), return_inverse=True)
        member = np.repeat(np.arange(len(rep)), size)
        order = np.argsort(shingle, kind="stable")
        posting = member[order]
        first = np.searchsorted(shingle[order], np.arange(shingle.max() + 1))
        last = np.append(first[1:], len(order))
        at = np.cumsum(size) - size
        root = list(range(len(rep)))

        def find(u: int) -> int:
            while root[u] != u:
                root[u] = u = root[root[u]]
            return u

        out: list[list[int]] = [[], []]
        for u in range(len(rep)):
            mine = shingle[at[u] : at[u] + size[u]]
            common = np.bincount(np.concatenate([posting[first[m] : last[m]] for m in mine]), minlength=len(rep))
            ok = 100 * common >= percent * (size + size[u] - common)
            ok[: u + 1] = False
            if table["i"][0].as_py() != j:
                ok &= block != block[u]
            for v in np.flatnonzero(ok).tolist():
                x, y = find(u), find(v)
                if x != y:
                    root[x] = y
                    out[0].append(max(rep[u], rep[v]))
                    out[1].append(min(rep[u], rep[v]))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return dealt.groupBy("team", "i", "j").applyInArrow(links, "a long, b long")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """The input rows that stand for their component, one row each, with their own columns.  Rows whose set is empty
    are linked with nothing and stay.  Of rows with one doc_id and one text one stays, and of rows without a doc_id one
    for each text that no row with a doc_id has."""
    gone = stage(cluster(docs, width, percent, side, rows).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = by_ids(docs, gone, "left_anti")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    repeated = stage(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    full = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    ids = repeated.where("doc_id is not null")
    once, twice = by_ids(kept, ids, "left_anti"), by_ids(kept, ids, "left_semi")
    known = docs.where("doc_id is not null").select("text").distinct()
    nameless = once.where(F.col("doc_id").isNull() & full).dropDuplicates(["text"]).join(known, "text", "left_anti").select(docs.columns)
    return once.where(F.col("doc_id").isNotNull() | ~full).unionByName(nameless).unionByName(twice.where(~full)).unionByName(twice.where(full).dropDuplicates(["doc_id", "text"]))
