"""Benchmark decontamination by Wu-Manber search over words.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  The patterns are the
windows of ``window`` consecutive words of each benchmark item (an item with fewer words is one pattern).
Patterns of one length form a table: an array of shifts, by a hash of the last block of two words, skips impossible
positions; sorted arrays of hashes of that suffix block and the first word select the windows to test; and comparing the
words with the item's confirms.  A window is a place in its item, so the tables take about 20 bytes for each.

The benchmark is a stated query set.  It is searched in blocks of items whose text is about ``block_bytes``, which are
gathered one at a time, so what the driver and a worker hold has a fixed bound; with more than one block the hits of a
document are merged by its id.  A worker builds the tables of a block once and keeps them for its tasks.

Defined results: a null or empty text has no words; a very long text is searched whole; items without words give no
window; a null item_id counts as an empty one; repeated rows (ties) give repeated results; an empty benchmark leaves every
document clean; other columns are ignored (``report``) or kept untouched (``keep_clean``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, stage, text_bytes

WINDOW = 10
#: Text of the benchmark items searched in one pass, about.
BLOCK_BYTES = 8 << 20

_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(_WORD).split() if body else []


class WuManber:
    """Tables over word patterns; ``search`` yields (start, length, items of the window there)."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        same: dict[bytes, bytes] = {}  # equal words are one object
        self.items = [item for item, _ in items]
        self.words = [[same.setdefault(w, w) for w in words_of(body)] for _, body in items]
        lengths: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if w:
                lengths.setdefault(min(window, len(w)), []).append(k)
        self.tables = [self._table(m, ks) for m, ks in sorted(lengths.items())]

    def _table(self, m: int, ks: list[int]) -> tuple:
        """(length, shifts, hashes of windows in order, their items, their places)."""
        count = np.array([len(self.words[k]) - m + 1 for k in ks])
        total = int(count.sum())
        shift = bytearray([max(1, m - 1) if m < 257 else 255]) * max(64, 1 << (4 * total).bit_length())
        mask = len(shift) - 1
        if m == 1:  # single words: a block of one
            for k in ks:
                shift[hash(self.words[k][0]) & mask] = 0
        else:
            for k in ks:
                w = self.words[k]
                for i in range(len(w) - 1):
                    # the block's last place in a window: any that starts early enough
                    left = max(0, m - 2 - i)
                    slot = hash((w[i], w[i + 1])) & mask
                    if left < shift[slot]:
                        shift[slot] = left
        hashes = np.fromiter((self._hash(w, i, m) for k in ks for w in (self.words[k],) for i in range(len(w) - m + 1)), np.int64, total)
        item = np.repeat(np.array(ks, np.int32), count)
        place = (np.arange(total) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        return m, shift, hashes[order], item[order], place[order]

    @staticmethod
    def _hash(w: list[bytes], start: int, m: int) -> int:
        """Of the suffix block and the first word of a window."""
        return hash((w[start], w[start + max(0, m - 2)], w[start + m - 1]))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, int, tuple]]:
        n = len(w)
        for m, shift, hashes, item, place in self.tables:
            mask, end = len(shift) - 1, m
            while end <= n:
                skip = shift[hash((w[end - 2], w[end - 1]) if m > 1 else w[end - 1]) & mask]
                if skip:
                    end += skip
                    continue
                start = end - m
                key = self._hash(w, start, m)
                at = int(np.searchsorted(hashes, key))
                found = []
                while at < len(hashes) and hashes[at] == key:
                    own, i = self.words[item[at]], int(place[at])
                    if own[i : i + m] == w[start:end]:
                        found.append(self.items[item[at]])
                    at += 1
                if found:
                    yield start, m, tuple(dict.fromkeys(found))
                end += 1


_tables: dict[str, WuManber] = {}


def forget_tables() -> None:
    _tables.clear()


def tables_of(key: str, block: list, window: int) -> WuManber:
    """The worker's tables of one block; tasks of one pass share them."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = WuManber(block, window)
    return _tables[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The query set in blocks of about ``block_bytes`` (a longer item is one of its own), one after the other; item ids
    as strings.  An item's block is a hash of its id and text."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("body"))
    count = -(-(rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // block_bytes) or 1
    placed = rows.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(count)))
    for k in range(count):
        yield [(r.item, bytes(r.body) if r.body is not None else None) for r in placed.where(F.col("block") == k).collect()]  # one block


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _pass(docs: DataFrame, block: list, window: int) -> DataFrame:
    """One pass over the documents: doc_id, n_words, hit spans and items of one block of the benchmark."""
    held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(name, held.value, window)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for body in b.column(1).to_pylist():
                w = words_of(body)
                spans, items = [], set()
                for start, size, found in tables.search(w):
                    spans.append((start, start + size))
                    items.update(found)
                merged = merge_spans(spans)
                for to, x in zip(out, (len(w), [s for s, _ in merged], [e for _, e in merged], sorted(items))):
                    to.append(x)
            yield batch(arrow, b.column(0), *out)

    return text_bytes(docs).mapInArrow(lean(run, "patterns", forget_tables), "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words (merged, in words, end exclusive), items with occurring windows."""
    bound_batches(docs.sparkSession)
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _pass(docs, first, window)
        return found.select("doc_id", "n_words", F.arrays_zip("starts", "ends").alias("spans"), "items")
    # More blocks: each is a pass of its own. Rows are told apart by id and text, and copies are counted once a block.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found, n_blocks = None, 0
    for block in (b for some in ((first, second), blocks) for b in some):
        one = stage(_pass_keyed(keyed, block, window), "hits")
        found, n_blocks = one if found is None else found.unionByName(one), n_blocks + 1
    merged = found.groupBy("doc_id", "h", "n_words").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / n_blocks).cast("int").alias("copies")
    )
    merged = stage(merged, "decontam")
    united = merged.mapInPandas(_unite, "doc_id long, n_words long, spans array<struct<starts: long, ends: long>>, items array<string>, copies int")
    return united.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def _pass_keyed(keyed: DataFrame, block: list, window: int) -> DataFrame:
    held, name = keyed.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    arrow = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(name, held.value, window)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for body in b.column(2).to_pylist():
                w = words_of(body)
                found = list(tables.search(w))
                merged = merge_spans([(s, s + n) for s, n, _ in found])
                for to, x in zip(out, (len(w), [s for s, _ in merged], [e for _, e in merged], sorted({i for _, _, items in found for i in items}))):
                    to.append(x)
            yield batch(arrow, b.column(0), b.column(1), *out)

    return text_bytes(keyed, "h").select("doc_id", "h", "body").mapInArrow(lean(run, "patterns", forget_tables), "doc_id long, h long, n_words long, starts array<long>, ends array<long>, items array<string>")


def _unite(frames):
    for f in frames:
        spans = [[{"starts": s, "ends": e} for s, e in merge_spans(list(zip(a, b)))] for a, b in zip(f.starts, f.ends)]
        yield f[["doc_id", "n_words", "items", "copies"]].assign(spans=spans)[["doc_id", "n_words", "spans", "items", "copies"]]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark, window, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["ends"] - s["starts"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input rows in which no window occurs, with their own columns; one narrow pass for each block of items."""
    bound_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for block in _blocks(benchmark, block_bytes):
        held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            tables = tables_of(name, held.value, window)
            for b in batches:
                clean = [next(tables.search(words_of(x)), None) is None for x in b.column(at).cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(lean(run, "patterns", forget_tables), schema)
    return docs
