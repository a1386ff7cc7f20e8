"""Line dedup with a sharded minimal perfect hash.

The distinct line hashes (128 bits) are split into shards of bounded size.  Each shard gets a minimal perfect
hash and, at its positions, compact arrays: a 32-bit fingerprint, a saturating count and the owner (the
smallest document id).  The lines of the documents go to the shard that holds them and probe the arrays; no
line text is joined.  A shard that frequent lines make hot is copied as often as its probes need, so that no
group of probes is larger than ``target`` rows, which is at most ``PROBES`` however large the table is.

Defined results: a null or empty text is one empty line; a very long text is one document with all its lines; rows with a
null doc_id own and lose nothing; two rows with one doc_id (ties, repeated rows) count as one document; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, mix64, shuffle_width, stage, text_bytes

SPACE = b" \t\n\v\f\r"
MIN_CHARS = 10
#: Bits for each key of a level of the hash; more bits, fewer levels.
GAMMA = 2
#: Line hashes of a shard, at most about; probes of one group, at most about.
SHARD_KEYS, PROBES = 1_000_000, 1_000_000


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


class MinimalPerfectHash:
    """A cascade of bit levels: a key sits on the first level where no other key has its bit; its position is
    the number of bits set before it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits)))).astype(np.int64) + total
            self.before.append(ones)
            total = int(ones[-1])
        self.size = total

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            size = max(64, -(-len(left) * GAMMA // 64) * 64)
            slot = cls._slot(left, len(levels), size)
            count = np.bincount(slot.astype(np.int64), minlength=size)
            alone = count == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[slot.astype(np.int64)]]
        return cls(levels)

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key; -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            slot = self._slot(keys[todo], level, len(bits) * 64)
            word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
            value = bits[word]
            here = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = (self.before[level][word] + below)[here]
            todo = todo[~here]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return head + b"".join(x.astype("<u8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", n, 4)
        at, levels = 4 + 4 * n, []
        for s in sizes.tolist():
            levels.append(np.frombuffer(raw, "<u8", s, at))
            at += 8 * s
        return cls(levels)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and both halves of the hash of each distinct line key of a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids, raw = [], []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if doc is None or not body:
                    continue
                own = {digest(k) for k in (line_key(x, min_chars) for x in body.split(b"\n")) if k is not None}
                ids += [doc] * len(own)
                raw.extend(own)
            halves = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
            yield batch(schema, ids, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]))

    return text_bytes(docs).mapInArrow(lean(run), "doc_id long, h1 long, h2 long")


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the hash and the arrays.  Counts and owners come from a partial aggregation, so a line
    that a third of all documents hold reaches a shard as one row of each map task."""
    stats = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
    schema = pa.schema([("shard", pa.int32()), ("load", pa.int64()), ("mph", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        h2 = table["h2"].to_numpy().view(np.uint64)
        n = table["n"].to_numpy()
        key = mix64(h1) ^ h2
        mph = MinimalPerfectHash.build(key)
        at = mph.positions(key)
        prints, counts, owners = np.zeros(mph.size, "<u4"), np.zeros(mph.size, "u1"), np.zeros(mph.size, "<i8")
        prints[at] = (h2 >> np.uint64(32)).astype("<u4")
        counts[at] = np.minimum(n, 255)
        owners[at] = table["owner"].to_numpy()
        many = counts > 1  # owners matter for repeated lines only
        return pa.Table.from_arrays([pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([int(n.sum())]), *(pa.array([x], pa.binary()) for x in (mph.to_bytes(), prints.tobytes(), counts.tobytes(), owners[many].tobytes()))], schema=schema)

    placed = stats.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInArrow(build, "shard int, load long, mph binary, prints binary, counts binary, owners binary")


def probe(keys: DataFrame, index: DataFrame, shards: int, target: int) -> DataFrame:
    """doc_id and hash of the lines that another, smaller document owns."""
    # At most (all probes) / target shards are hotter than target: 4 a shuffle partition, or one row for a million probes.
    hot = index.where(F.col("load") > target).select("shard", F.ceil(F.col("load") / target).cast("int").alias("salts"))
    sent = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(F.broadcast(hot), "shard", "left")
    sent = sent.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salts = F.ceil(F.greatest(F.col("load"), F.lit(1)) / target).cast("int")
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary())])

    def run(lines: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(lines) or not len(shard):
            return schema.empty_table()
        h1 = np.ascontiguousarray(lines["h1"].to_numpy()).view(np.uint64)
        h2 = np.ascontiguousarray(lines["h2"].to_numpy()).view(np.uint64)
        doc = lines["doc_id"].to_numpy()
        get = lambda c: shard[c][0].as_py()
        mph = MinimalPerfectHash.from_bytes(get("mph"))
        prints, counts = np.frombuffer(get("prints"), "<u4"), np.frombuffer(get("counts"), "u1")
        owners = np.zeros(mph.size, np.int64)
        owners[counts > 1] = np.frombuffer(get("owners"), "<i8")
        at = mph.positions(mix64(h1) ^ h2)
        ok = at >= 0
        ok[ok] &= prints[at[ok]] == (h2[ok] >> np.uint64(32)).astype("<u4")
        ok[ok] &= counts[at[ok]] > 1
        ok[ok] &= owners[at[ok]] != doc[ok]
        raw = np.stack([h1[ok], h2[ok]], 1).astype("<u8")
        return pa.Table.from_arrays([pa.array(doc[ok]), pa.array([x.tobytes() for x in raw], pa.binary())], schema=schema)

    grouped = sent.groupBy("shard", "salt").cogroup(arrays.drop("load").groupBy("shard", "salt"))
    return grouped.applyInArrow(run, "doc_id long, h binary")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (what is left).  Keys of ``min_chars`` code points or more that
    two documents hold stay only in the smallest doc_id that holds them."""
    spark = docs.sparkSession
    bound_batches(spark)
    keys = stage(line_hashes(docs, min_chars), "line-hashes")
    n_keys = keys.count()
    target = min(PROBES, max(500, n_keys // (4 * shuffle_width(spark))))
    shards = max(8 * shuffle_width(spark), n_keys // SHARD_KEYS)
    index = stage(build_index(keys, shards), "line-index")
    drops = probe(keys, index, shards, target).groupBy("doc_id").agg(F.collect_list("h").alias("drops"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            n_lines, n_dropped, texts = [], [], []
            for body, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = (body or b"").split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    keyed = ((x, line_key(x, min_chars)) for x in lines)
                    kept = [x for x, k in keyed if k is None or digest(k) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept) if drop else body or b"")
            yield batch(schema, b.column(0), n_lines, n_dropped, pa.array(texts, pa.binary()).cast(pa.string()))

    # Rows without an id lose nothing and stay where they are.
    whole = text_bytes(docs)
    told = whole.where("doc_id is not null").join(drops, "doc_id", "left")
    told = told.unionByName(whole.where("doc_id is null").withColumn("drops", F.lit(None).cast("array<binary>")))
    return told.mapInArrow(lean(run), "doc_id long, n_lines long, n_dropped long, text string")


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return dedup(docs, min_chars).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
