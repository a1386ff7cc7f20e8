"""Token ids in directly addressable codes.

Encoding: a text is cut at places where the byte-level pre-tokenizer always cuts (around white space, and where an
ASCII mark follows a letter or digit), each distinct piece is encoded by the tokenizers library once, and the ids are
put together; the result equals encoding the whole text.  Pieces of up to 16 bytes are told apart by those bytes,
longer ones by theirs in a dictionary, so two pieces are never taken for one.  Texts with special tokens, zero bytes or
white space beyond ASCII are encoded whole.

Files: a table of segments in ascending doc_id order, in the shared folder or at a given path.  A segment holds the ids
of some documents as chunk levels: level 0 has the low 8 bits of every id, level l + 1 the next bits of those ids that
go on.  A bitmap for each level says which ids go on, and a directory has the set bits before each block of 512, so that
the place of an id on the next level is a rank.  Any id, or any run of ids, is read from its own bytes of each level
without decoding others: ``read`` goes to each document in this way, ``tokens_at`` to any token of the whole table.

Defined results: a null or empty text has only the end id; invalid UTF-8 is read with replacement characters; a very
long text is a segment of its own; equal doc_ids (ties, repeated rows) are ordered by their ids' bytes; null doc_ids come
first; an empty table gives an empty table of segments; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, mix64, stage, text_bytes

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Ids of a segment, about; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
#: Text of a bucket (one task of writing, which holds one segment at a time), about; and how many there are at most.
BUCKET_BYTES, BUCKETS = 12 << 20, 50_000
BLOCK = 512
MAGIC = b"PWDC"

#: Kinds of bytes: ASCII white space, ASCII letter or digit, other ASCII; the rest is 0.
_WHITE, _WORD, _MARK = 1, 2, 3
_KIND = np.array([0 if c > 127 else _WHITE if c == 32 or 9 <= c <= 13 else _WORD if chr(c).isalnum() else _MARK for c in range(256)], np.uint8)
#: The first n of 8 bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: A word of Latin letters, which is one piece of the pre-tokenizer.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+")
#: Fixed: how byte-level vocabularies write bytes; printable ones as they are, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in _PRINTED) if c != 10}
#: Longer pieces are not kept.
_KEPT_BYTES = 64


def tokenizer_path(vocabulary: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def piece_starts(a: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts that lie at ``begin`` to ``end``, one after the other, none empty.

    Of a run of white space before a word the last one is apart, and a blank there belongs to the word."""
    kind = _KIND[a]
    white = kind == _WHITE
    before = np.empty_like(white)
    before[1:] = white[:-1]
    before[begin] = False
    after = np.empty_like(white)
    after[:-1] = ~white[1:]
    after[end - 1] = False
    first = white & (~before | after)
    blank = np.empty_like(white)
    blank[1:] = a[:-1] == 32
    blank[0] = False
    first |= ~white & before & ~blank
    letter = np.zeros_like(white)
    letter[1:] = kind[:-1] == _WORD
    if (a > 127).any():  # two-byte Latin letters, but for the times and division signs
        pair = (a[:-2] >= 0xC3) & (a[:-2] <= 0xC9) & ~((a[:-2] == 0xC3) & ((a[1:-1] == 0x97) | (a[1:-1] == 0xB7)))
        letter[2:] |= pair
    first |= (kind == _MARK) & letter
    first[begin] = True
    return np.flatnonzero(first)


def _wide_spaces(a: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    at = np.flatnonzero((a == 0xC2) | (a == 0xE1) | (a == 0xE2) | (a == 0xE3))
    x, y, z = a[at], *(np.take(a, at + k, mode="clip") for k in (1, 2))
    wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    wide |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
    return at[wide]


class PieceTable:
    """Rows of pieces by their bytes (two words of 8, zeros behind): open addressing in arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.row = np.zeros(slots, np.int32)  # one more than the row; 0 where free
        self.words = np.zeros((slots, 2), np.uint64)
        self.used = 0

    @staticmethod
    def hash(words: np.ndarray) -> np.ndarray:
        return mix64(words[:, 0] + mix64(words[:, 1] + np.uint64(0x9E3779B97F4A7C15)))

    def find(self, words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 where there is none."""
        out = np.full(len(words), -1, np.int64)
        todo = np.arange(len(words))
        at = (hashed & np.uint64(len(self.row) - 1)).astype(np.int64)
        while len(todo):
            row = self.row[at]
            taken = row > 0
            same = taken & (self.words[at] == words[todo]).all(axis=1)
            out[todo[same]] = row[same] - 1
            go = taken & ~same
            todo, at = todo[go], (at[go] + 1) & (len(self.row) - 1)
        return out

    def add(self, words: np.ndarray, rows: np.ndarray) -> None:
        """Distinct pieces that are not there yet."""
        if 10 * (self.used + len(rows)) > 7 * len(self.row):
            held = np.flatnonzero(self.row)
            words, rows = np.concatenate((self.words[held], words)), np.concatenate((self.row[held] - 1, rows))
            slots = len(self.row)
            while 10 * len(rows) > 7 * slots:
                slots *= 2
            self.__init__(slots)
        self.used += len(rows)
        todo = np.arange(len(rows))
        at = (self.hash(words) & np.uint64(len(self.row) - 1)).astype(np.int64)
        while len(todo):
            free = self.row[at] == 0
            self.row[at[free]] = rows[todo[free]] + 1
            won = free & (self.row[at] == rows[todo] + 1)  # of several for one place the last
            self.words[at[won]] = words[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (len(self.row) - 1)


class Encoder:
    """Ids of whole texts.  The pieces of many texts are looked up together, new ones are encoded, and the ids are
    gathered from one array."""

    def __init__(self, path: str, room: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = "<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.table, self.long = PieceTable(1 << max(8, (self.room * 10 // 7).bit_length())), {}
        self.at, self.count, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.store, self.used = np.zeros(1 << 14, self.kind), 0

    def _keep(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces; their rows."""
        ids = self._encode_pieces(pieces)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        while self.rows + len(ids) > len(self.at):
            self.at, self.count = np.concatenate((self.at, self.at)), np.concatenate((self.count, self.count))
        while self.used + total > len(self.store):
            self.store = np.concatenate((self.store, self.store))
        rows = np.arange(self.rows, self.rows + len(ids))
        self.count[rows] = counts
        self.at[rows] = self.used + np.cumsum(counts) - counts
        self.store[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), self.kind, total)
        self.rows, self.used = self.rows + len(ids), self.used + total
        return rows

    def _encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """A word of letters goes to the model at once, written as the vocabulary writes bytes; other pieces go
        through the whole tokenizer."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if _LETTERS.fullmatch(p)]
        written = b"\n".join(pieces[i] for i in plain).decode("latin-1").translate(_WRITTEN).split("\n")
        merge = self.model.model.tokenize
        for i, w in zip(plain, written):
            out[i] = [t.id for t in merge(w)]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.model.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"".join(texts)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        odd = self._odd(texts, raw)
        even = [i for i, t in enumerate(texts) if t and i not in odd]
        for i, ids in zip(even, self._encode_even([texts[i] for i in even], raw if len(even) == len(texts) else None)):
            out[i] = ids
        whole = sorted(odd)
        for i, e in zip(whole, self.model.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.kind)
        return out

    def _odd(self, texts: list[bytes], raw: bytes) -> set[int]:
        """The texts that are encoded whole."""
        marks = [s for s in (*self.special, b"\0") if s in raw]
        odd = {i for i, t in enumerate(texts) if any(s in t for s in marks)} if marks else set()
        if raw.isascii():
            return odd
        wide = _wide_spaces(np.frombuffer(raw, np.uint8))
        odd.update(np.searchsorted(np.cumsum(list(map(len, texts))), wide, side="right").tolist())
        try:
            raw.decode()
        except UnicodeDecodeError:
            odd.update(i for i, t in enumerate(texts) if t.decode("utf-8", "replace").encode() != t)
        return odd

    def _encode_even(self, texts: list[bytes], raw: bytes | None) -> list[np.ndarray]:
        if not texts:
            return []
        if self.rows > self.room or self.used > 8 * self.room:
            self.clear()
        raw = raw if raw is not None else b"".join(texts)
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        end_of = np.cumsum(list(map(len, texts)))
        begin_of = np.concatenate(([0], end_of[:-1]))
        start = piece_starts(padded[: len(raw)], begin_of, end_of)
        end = np.append(start[1:], len(raw))
        size = end - start
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the 8 bytes from any place on
        words = np.empty((len(start), 2), np.uint64)
        words[:, 0] = eight[start] & _FIRST[np.minimum(size, 8)]
        words[:, 1] = eight[np.minimum(start + 8, len(raw))] & _FIRST[np.clip(size - 8, 0, 8)]
        short = size <= 16
        row = np.empty(len(start), np.int64)
        row[short] = self._short(raw, start[short], end[short], words[short])
        row[~short] = self._long(raw, start[~short], end[~short])
        count = self.count[row].astype(np.int64)
        done = np.cumsum(count)
        ids = self.store[np.repeat(self.at[row] - done + count, count) + np.arange(done[-1])]
        cuts = done[np.searchsorted(start, end_of[:-1]) - 1]
        return np.split(ids, cuts)

    def _short(self, raw: bytes, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        code, distinct = pd.factorize(PieceTable.hash(words))
        example = np.empty(len(distinct), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        if (words[example][code] != words).any():  # two pieces of one hash: tell them apart by their bytes
            code = np.unique(words, axis=0, return_inverse=True)[1].reshape(-1)
            example = np.empty(code.max() + 1, np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]
            distinct = PieceTable.hash(words[example])
        own = words[example]
        rows = self.table.find(own, distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            at = example[new]
            rows[new] = self._keep([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
            self.table.add(own[new], rows[new])
        return rows[code]

    def _long(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> list[int]:
        pieces = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
        new = [p for p in dict.fromkeys(pieces) if p not in self.long]
        own = dict(zip(new, self._keep(new).tolist())) if new else {}
        out = [own[p] if p in own else self.long[p] for p in pieces]
        self.long |= {p: r for p, r in own.items() if len(p) <= _KEPT_BYTES}
        return out


_encoders: dict[str, Encoder] = {}


def forget_encoders() -> None:
    _encoders.clear()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# The codes


class Codes:
    """Chunk levels with continuation bitmaps and rank directories over one array of ids."""

    def __init__(self, size: int, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.size, self.levels, self.bitmaps, self.ranks = size, levels, bitmaps, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> Codes:
        left = ids.astype(np.uint32)
        levels, bitmaps, ranks = [], [], []
        while True:
            levels.append((left & np.uint32(255)).astype(np.uint8))
            left = left >> np.uint32(8)
            more = left > 0
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits)
            per = np.add.reduceat(np.bitwise_count(bits).astype(np.uint32), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(per)[:-1])).astype("<u4") if len(per) else np.zeros(0, "<u4"))
            if not more.any():
                return cls(len(ids), levels, bitmaps, ranks)
            left = left[more]

    def _rank(self, level: int, i: int) -> int:
        """How many of the first ``i`` ids of a level go on: one directory entry and the bits of one block."""
        bits, block = self.bitmaps[level], i // BLOCK
        if block == len(self.ranks[level]):  # behind the last block
            block -= 1
        if block < 0:
            return 0
        byte, bit = divmod(i, 8)
        part = int(bits[byte] & (1 << bit) - 1).bit_count() if bit else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(bits[block * BLOCK // 8 : byte]).sum()) + part

    def __getitem__(self, i: int) -> int:
        """The i-th id: one byte, one bit and one rank a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, chunk in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * level
            if not self.bitmaps[level][i // 8] >> i % 8 & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("an id goes on after the last level")

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: a rank a level says where their next chunks are."""
        if not 0 <= start <= stop <= self.size:
            raise IndexError((start, stop))
        parts = []
        for level, chunk in enumerate(self.levels):
            byte = start // 8
            bits = np.unpackbits(self.bitmaps[level][byte : -(-stop // 8)], bitorder="little")[start - 8 * byte :][: stop - start].astype(bool)
            parts.append((chunk[start:stop], bits))
            n = int(bits.sum())
            if not n:
                break
            start = self._rank(level, start)
            stop = start + n
        value = np.zeros(0, np.uint32)
        for chunk, bits in reversed(parts):
            out = chunk.astype(np.uint32)
            out[bits] |= value << np.uint32(8)
            value = out
        return value

    def to_bytes(self) -> bytes:
        head = np.array([self.size, len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return MAGIC + head + b"".join(x.tobytes() for parts in zip(self.levels, self.bitmaps, self.ranks) for x in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codes:
        """Views into ``raw``; nothing is decoded."""
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of codes")
        size, n = map(int, np.frombuffer(raw, "<u4", 2, 4))
        sizes = np.frombuffer(raw, "<u4", n, 12).tolist()
        at, levels, bitmaps, ranks = 12 + 4 * n, [], [], []
        for s in sizes:
            for to, kind, count in ((levels, np.uint8, s), (bitmaps, np.uint8, -(-s // 8)), (ranks, "<u4", -(-s // BLOCK))):
                to.append(np.frombuffer(raw, kind, count, at))
                at += to[-1].nbytes
        return cls(size, levels, bitmaps, ranks)


# Writing and reading


def write(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, path: str | None = None, segment_ids: int = SEGMENT_IDS, out: str | None = None) -> DataFrame:
    """The table of segments: bucket, place, first (ids of the bucket before it), n_ids, doc_ids, sizes, codes.

    ``path`` is the tokenizer's file; ``out`` the folder that keeps the table (read it with ``spark.read.parquet``).
    Without ``out`` the table is in the shared folder and goes when the driver ends."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(BUCKETS, -(-text // BUCKET_BYTES) or 1)  # follows the data; the driver holds one edge for each
    bounds = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    edges = np.unique(np.array(bounds or [0.0]))
    kind = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("kind", pa.string()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or tokenizer_path(vocabulary))
        end = np.array([end_id], coder.kind).tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            doc = b.column(0).to_pylist()
            at = np.searchsorted(edges, [-np.inf if d is None else d for d in doc], side="right").astype(np.int32)
            ids = coder.encode([t or b"" for t in b.column(1).to_pylist()])
            yield batch(kind, at, b.column(0), [coder.kind] * len(doc), [pack(x.tobytes() + end) for x in ids])

    encoded = text_bytes(docs).mapInArrow(lean(encode, "tokens", forget_encoders), "bucket int, doc_id long, kind string, ids binary")
    dealt = encoded.repartitionById(len(edges) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    schema = pa.schema([("bucket", pa.int32()), ("place", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        bucket, place, first, held, docs_, sizes, ids, kind = None, 0, 0, 0, [], [], [], ""

        def flush():
            codes = Codes.build(np.frombuffer(b"".join(ids), kind))
            return batch(schema, [bucket], [place], [first], [held], [docs_], [sizes], [codes.to_bytes()])

        for b in batches:
            for k, doc, kind, raw in zip(*(c.to_pylist() for c in b.columns)):
                if k != bucket or held >= segment_ids:
                    if docs_:
                        yield flush()
                    place, first = (place + 1, first + held) if k == bucket else (0, 0)
                    bucket, held, docs_, sizes, ids = k, 0, [], [], []
                raw = unpack(raw)
                docs_.append(doc)
                sizes.append(len(raw) // int(kind[2]))
                held += sizes[-1]
                ids.append(raw)
        if docs_:
            yield flush()

    segments = dealt.mapInArrow(lean(build), "bucket int, place int, first long, n_ids long, doc_ids array<long>, sizes array<long>, codes binary")
    return stage(segments, "token-codes", out)


def _bases(segments: DataFrame) -> dict[int, int]:
    """The ids before each bucket; at most ``BUCKETS`` entries."""
    totals = dict(sorted(segments.groupBy("bucket").agg(F.sum("n_ids").alias("n")).toPandas().itertuples(index=False)))
    base, total = {}, 0
    for k, n in totals.items():
        base[int(k)] = total
        total += int(n)
    return base


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, which is looked up in its segment on its own."""
    base = _bases(segments)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes = Codes.from_bytes(row["codes"])
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                crc = [zlib.crc32(codes.run(s, e).astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                yield batch(schema, row["doc_ids"], starts + base[row["bucket"]] + row["first"], row["sizes"], crc)

    return segments.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Places looked up in a segment by one row of work, at most.
_RUN = 1 << 16


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """place, token for each distinct ``place`` (of all ids in doc_id order, from 0); places outside are left out.  A
    place finds its segment by a join on ranges of places, and its token by one byte, bit and rank a level."""
    spark = segments.sparkSession
    base = _bases(segments)
    bases = spark.createDataFrame(list(base.items()), "bucket int, base long")
    whole = segments.select("bucket", "place", "first", "n_ids").join(F.broadcast(bases), "bucket")  # a row a bucket
    lo = F.col("base") + F.col("first")
    cells = whole.select("bucket", F.col("place").alias("part"), lo.alias("lo"), (lo + F.col("n_ids")).alias("hi"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / SEGMENT_IDS), F.floor((F.col("hi") - 1) / SEGMENT_IDS))))
    asked = places.select(F.col("place").cast("long").alias("at")).where("at is not null").distinct().withColumn("cell", F.floor(F.col("at") / SEGMENT_IDS))
    met = asked.join(cells, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    inside = F.col("at") - F.col("lo")
    work = met.groupBy("bucket", "part", "lo", F.floor(inside / _RUN).alias("run")).agg(F.collect_list(inside).alias("inside"))
    schema = pa.schema([("place", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, inside, raw in zip(*(c.to_pylist() for c in b.columns)):
                codes = Codes.from_bytes(raw)
                yield batch(schema, [lo + i for i in inside], [codes[i] for i in inside])

    found = work.join(segments.select("bucket", F.col("place").alias("part"), "codes"), ["bucket", "part"]).select("lo", "inside", "codes")
    return found.mapInArrow(lean(run), "place long, token long")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    return read(write(docs, vocabulary, end_id, path))
