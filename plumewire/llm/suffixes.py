"""Removal of passages that an earlier document holds, over a suffix array in buckets.

The suffixes are cut at ``span`` bytes (windows).  A window's leading token is the one of its ``TOKEN``-byte strings with
the smallest hash, so equal windows have equal tokens wherever they stand, and the windows of a document that follow each
other under one token are a fragment: a fragment of f windows travels as span + f - 1 bytes and not as f suffixes.

1. Documents with equal texts meet by their digest; all but the smallest doc_id go whole, and take no part in the rest.
2. Fragments, as (token, digest of the fragment, doc_id), are range-partitioned by token with sampled splitters and sorted.
   A fragment that an earlier document has too goes whole.  What is left of a fragment, once, is of interest only where
   another fragment has its token.
3. Those fragments, now with their bytes, are range-partitioned by token again.  Each bucket sorts its windows by multikey
   quicksort: ranges of windows are split by their next eight bytes, and only runs of equal ones go deeper; all ranges of
   one depth are split at once.  Equal windows then stand together, and those of later documents go.
4. A token with more rows than a bucket should have, or than one chunk of a bucket, is split over buckets or chunks.  Each of
   them hands on its earliest occurrence of each such window, and these are compared across the boundaries.

Step 2 may take a fragment for one of interest that is none (at the edges of a bucket), never the other way round, and
step 3 is exact, so the result doesn't depend on where the splitters lie.  Digests have 128 bits (a fragment's: 64, and
64 of its token).

Defined results: a null text counts as empty; a text shorter than ``span`` loses nothing; a very long text is cut into
pieces that overlap, which changes nothing; rows with a null doc_id neither lose bytes nor make others lose them; rows with
one doc_id (ties, repeated rows) are one document to others and not earlier than each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bound_batches, by_ids, lean, mix64, shuffle_width, stage, text_bytes
from .minhash import _meet

SPAN, TOKEN = 50, 24
#: Bytes of text worked on at once; windows of a fragment at most; bytes of fragments (or rows without bytes) of a chunk.
PIECE, LONGEST, CHUNK, CHUNK_ROWS = 1 << 18, 256, 4 << 20, 1 << 19
#: Tokens in the sample that splitters are taken from, at most about; the splitters only say where work is done.  A token is
#: split over buckets if it has more rows than ``SPLIT``.
SAMPLE, SPLIT = 20_000, 1 << 15

#: A number and its inverse, whose powers tell the places in a text.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def forget_powers() -> None:
    _powers.clear()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << (n - 1).bit_length()
    if size not in _powers:
        _powers[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (_BASE, _INVERSE))
    return _powers[size]


def pieces(bodies: list[bytes], span: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(place in the list, offset, bytes) in lists of about ``PIECE`` bytes; longer texts are cut, with an overlap."""
    some, size = [], 0
    for k, body in enumerate(bodies):
        for at in range(0, len(body) - span + 1, PIECE):
            part = body[at : at + PIECE + span - 1]
            some.append((k, at, part))
            size += len(part)
            if size >= PIECE:
                yield some
                some, size = [], 0
    if some:
        yield some


def described(bodies: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each fragment of some texts, in order: the text's place in the list, the start in it, the number of windows, the
    token's hash and the fragment's digest."""
    for some in pieces(bodies, span):
        data = b"".join(x for _, _, x in some) + bytes(TOKEN + span)
        n = len(data) - TOKEN - span
        mixed = mix64(np.ndarray((n + TOKEN,), "<u8", data, strides=(1,)).astype(np.uint64))
        least = mixed[:n].copy()
        for k in range(8, TOKEN, 8):
            least *= np.uint64(_BASE)
            least ^= mixed[k : n + k]
        width, rest = 1, span - TOKEN + 1
        while 2 * width <= rest:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < rest:
            least = np.minimum(least[: width - rest], least[rest - width :])
        # Windows that end inside their text, in order.
        size = np.array([len(x) for _, _, x in some])
        first, count = np.cumsum(size) - size, size - span + 1
        before = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(first - before, count)
        token = least[at]
        new = np.append(True, token[1:] != token[:-1])
        new[before] = True
        start = np.flatnonzero(new)
        runs = np.diff(np.append(start, len(token)))
        if runs.max() > LONGEST:
            parts = -(-runs // LONGEST)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            runs = np.minimum(np.repeat(runs, parts) - step * LONGEST, LONGEST)
            start = np.repeat(start, parts) + step * LONGEST
        # The digest: what the fragment's strings of eight bytes add up to, each weighted by its place in it.
        begin = at[start]
        up, down = powers(n + TOKEN)
        total = np.cumsum(mixed * up[: n + TOKEN])
        prints = total[begin + runs + (span - 9)] - total[begin] + mixed[begin] * up[begin]
        prints = mix64(prints * down[begin] + runs.astype(np.uint64))
        of = np.searchsorted(before, start, "right") - 1
        place, offset = np.array([k for k, _, _ in some]), np.array([at_ for _, at_, _ in some])
        yield place[of], begin - first[of] + offset[of], runs, token[start], prints


def _key(place: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """One number for a text of a batch and a fragment's digest."""
    return mix64(prints + place.astype(np.uint64) * np.uint64(_BASE))


def _signed(docs: DataFrame, span: int) -> DataFrame:
    """doc_id and digest of the texts that have a window."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), [xxhash.xxh3_128_digest(x) for x in b.column(1).to_pylist()])

    some = text_bytes(docs).where(f"doc_id is not null and octet_length(body) >= {span}")
    return some.mapInArrow(lean(run), "doc_id long, digest binary")


def splitters(tokens: list[int], buckets: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens at which ``buckets`` ranges meet, and those of them that are split because they may have more than ``SPLIT`` of
    the ``rows`` rows, and more than a range's share."""
    held = np.sort(np.array(tokens, np.int64))
    if not len(held):
        return held, held
    cuts = held[(np.arange(1, buckets) * len(held)) // buckets]
    known, count = np.unique(held, return_counts=True)
    many = known[count * (rows / len(held)) > SPLIT]
    again, times = np.unique(cuts, return_counts=True)
    return cuts, np.intersect1d(many, again[times > 1])


def bucket_of(token: np.ndarray, other: np.ndarray, cuts: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The range of a token; rows of a split one are dealt over the ranges that meet there."""
    high = np.searchsorted(cuts, token, "right")
    hot = np.flatnonzero(np.isin(token, split))
    if len(hot):
        low = np.searchsorted(cuts, token[hot], "left")
        high[hot] = low + (mix64(other[hot].astype(np.uint64)) % (high[hot] - low + 1).astype(np.uint64)).astype(np.int64)
    return high.astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch], weigh, most: int) -> Iterator[tuple[pa.Table, set]]:
    """Rows in order of ``token`` in tables of about ``most``, cut between tokens; a token of more rows than that is cut, and
    is in the set that comes with each of its tables."""
    held, weight, cut = [], 0, set()
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        weight += weigh(b)
        if weight < most:
            continue
        table = pa.Table.from_batches(held)
        token = table["token"].to_numpy()
        at = int(np.searchsorted(token, token[-1], "left"))
        if at:
            yield table.slice(0, at), cut
            held, cut = table.slice(at).to_batches(), cut & {int(token[-1])}
        else:
            cut = cut | {int(token[-1])}
            yield table, cut
            held = []
        weight = sum(map(weigh, held))
    if held:
        yield pa.Table.from_batches(held), cut


def _repeats(rows: DataFrame, split: np.ndarray) -> DataFrame:
    """doc_id, print, token, whole: fragments that an earlier document has too (whole), and of the other ones those whose
    token may be another fragment's."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("token", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in _chunks(batches, len, CHUNK_ROWS):
            token, prints, doc = (table[c].to_numpy() for c in ("token", "print", "doc_id"))
            new_token = np.append(True, token[1:] != token[:-1])
            new = new_token | np.append(True, prints[1:] != prints[:-1])
            group = np.cumsum(new) - 1
            later = doc > doc[np.flatnonzero(new)][group]
            kinds = np.add.reduceat(new, np.flatnonzero(new_token))[np.cumsum(new_token) - 1]
            lone = (kinds == 1) & ~np.isin(token, np.append(split, np.fromiter(cut, np.int64, len(cut))))
            keep = later | new & ~lone
            yield batch(schema, doc[keep], prints[keep], token[keep], later[keep])

    ordered = rows.sortWithinPartitions("token", "print", "doc_id").select("token", "print", "doc_id")
    return ordered.mapInArrow(lean(run), "doc_id long, print long, token long, whole boolean")


def sorted_ties(data: bytes, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal another one: their places in ``at`` in order, and where a new run begins.  Multikey quicksort with
    symbols of eight bytes, all ranges of a depth at once."""
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    order, range_ = np.arange(len(at)), None
    for depth in [*range(0, span - 8, 8), span - 8]:
        symbol = eight[at[order] + depth].astype(np.uint64)
        by = np.argsort(symbol) if range_ is None else np.lexsort((symbol, range_))
        order, symbol = order[by], symbol[by]
        new = np.append(True, symbol[1:] != symbol[:-1])[: len(order)]
        if range_ is not None:
            range_ = range_[by]
            new[1:] |= range_[1:] != range_[:-1]
        alone = new & np.append(new[1:], True)[: len(order)]
        range_ = np.cumsum(new)[~alone]
        order, new = order[~alone], new[~alone]
    return order, new


def _compared(rows: DataFrame, split: np.ndarray, span: int) -> DataFrame:
    """doc_id, print, offsets of windows that an earlier document has; and with their digest (w1, w2) the earliest ones here
    of those windows that other buckets may have too.  rows: token, print, doc_id, bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("offsets", pa.list_(pa.int32())), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for table, cut in _chunks(batches, lambda b: b.nbytes, CHUNK):
            token, prints, doc = (table[c].to_numpy() for c in ("token", "print", "doc_id"))
            texts = table["body"].to_pylist()
            size = np.array([len(x) for x in texts])
            data, windows = b"".join(texts), size - span + 1
            own = np.repeat(np.arange(len(texts)), windows)
            offset = np.arange(len(own)) - (np.cumsum(windows) - windows)[own]
            at = offset + (np.cumsum(size) - size)[own]
            edge = np.isin(token, np.append(split, np.fromiter(cut, np.int64, len(cut))))
            order, new = sorted_ties(data, at, span)
            first = doc[own]  # the earliest document with a window
            if len(order):
                least = np.minimum.reduceat(doc[own[order]], np.flatnonzero(new))
                first[order] = least[np.cumsum(new) - 1]
            later = np.flatnonzero(doc[own] > first)
            of, begin = np.unique(own[later], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(later)), pa.int32()), pa.array(offset[later].astype(np.int32)))
            yield batch(schema, doc[of], prints[of], lists, pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.int64()))
            asked = np.flatnonzero(edge[own] & (doc[own] == first))
            for k in range(0, len(asked), 1 << 16):
                some = asked[k : k + (1 << 16)]
                halves = np.frombuffer(b"".join(digest(data[p : p + span]) for p in at[some].tolist()), "<i8").reshape(-1, 2)
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1), pa.int32()), pa.array(offset[some].astype(np.int32)))
                yield batch(schema, doc[own[some]], prints[own[some]], one, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]))

    ordered = rows.sortWithinPartitions("token", "print").select("token", "print", "doc_id", "body")
    return ordered.mapInArrow(lean(run), "doc_id long, print long, offsets array<int>, w1 long, w2 long")


def _sampled(tokens: DataFrame, rows: int) -> list[int]:
    """About ``SAMPLE`` of the values of the column ``token`` of ``rows`` rows."""
    one_in = max(1, rows // SAMPLE)
    return [r.token for r in tokens.where(F.pmod(F.xxhash64(*tokens.columns), F.lit(one_in)) == 0).select("token").limit(2 * SAMPLE).collect()]


def removals(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, copies (digests of texts that go whole), parts (print and offsets of the windows that go, null: all)."""
    width = shuffle_width(docs.sparkSession)
    signed = stage(_signed(docs, span), "signed")
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("digest", "rep")
    copies = stage(_meet(signed, stage(classes, "classes"), "digest", "doc_id").where("doc_id > rep").select("doc_id", "digest"), "copies")
    n = signed.groupBy("doc_id").agg(F.count("*").alias("n"))
    gone = stage(copies.groupBy("doc_id").agg(F.count("*").alias("gone")).join(n, "doc_id").where("gone = n").select("doc_id"), "gone")
    reps = by_ids(docs.where("doc_id is not null"), gone, "left_anti")

    def fragments_of(some: DataFrame, cuts: np.ndarray, split: np.ndarray, one_in: int = 1) -> DataFrame:
        schema = pa.schema([("bucket", pa.int32()), ("token", pa.int64()), ("print", pa.int64()), ("doc_id", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy()
                for of, _, _, token, prints in described(b.column(1).to_pylist(), span):
                    doc, token = ids[of], token.view(np.int64)
                    if one_in > 1:
                        few = mix64(prints ^ doc.astype(np.uint64)) % np.uint64(one_in) == 0
                        doc, token, prints = doc[few], token[few], prints[few]
                    yield batch(schema, bucket_of(token, prints ^ doc.astype(np.uint64), cuts, split), token, prints.view(np.int64), doc)

        return text_bytes(some).where(f"octet_length(body) >= {span}").mapInArrow(lean(run, "powers", forget_powers), "bucket int, token long, print long, doc_id long")

    # The sample: fragments of some documents, and of those one in 16.
    few, none = max(1, signed.count() // 2000), np.empty(0, np.int64)
    sample = [r.token for r in fragments_of(reps.where(F.pmod(F.xxhash64("doc_id"), F.lit(few)) == 0), none, none, 16).select("token").limit(2 * SAMPLE).collect()]
    cuts, split = splitters(sample, width, len(sample) * 16 * few)
    found = stage(_repeats(fragments_of(reps, cuts, split).repartitionById(width, "bucket"), split), "repeats")

    asked = found.where("not whole")
    n_asked = asked.count()
    cuts2, split2 = splitters(_sampled(asked.select("token", "print", "doc_id"), n_asked), width, n_asked)
    lists = asked.groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
    schema = pa.schema([("bucket", pa.int32()), ("token", pa.int64()), ("print", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary())])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bodies, wanted = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2)
            of_list = np.repeat(np.arange(len(b)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            keys = _key(of_list, wanted.flatten().to_numpy().view(np.uint64))
            for of, start, runs, token, prints in described(bodies, span):
                key = _key(of, prints)
                some = np.flatnonzero(np.isin(key, keys))
                some = some[np.unique(key[some], return_index=True)[1]]  # a text's equal fragments are one row
                doc, token, prints = ids[of[some]], token[some].view(np.int64), prints[some]
                texts = [bodies[k][s:e] for k, s, e in zip(of[some].tolist(), start[some].tolist(), (start + runs + span - 1)[some].tolist())]
                yield batch(schema, bucket_of(token, prints ^ doc.astype(np.uint64), cuts2, split2), token, prints.view(np.int64), doc, texts)

    texts = text_bytes(reps).where(f"octet_length(body) >= {span}").join(lists, "doc_id").mapInArrow(lean(cut_out, "powers", forget_powers), "bucket int, token long, print long, doc_id long, body binary")
    parts = stage(_compared(texts.repartitionById(width, "bucket"), split2, span), "parts")
    across = parts.where("w1 is not null").withColumn("first", F.min("doc_id").over(Window.partitionBy("w1", "w2"))).where("doc_id > first")
    going = parts.where("w1 is null").select("doc_id", "print", "offsets").unionByName(across.select("doc_id", "print", "offsets"))
    going = going.unionByName(found.where("whole").select("doc_id", "print", F.lit(None).cast("array<int>").alias("offsets")))
    some, copy = F.struct("print", "offsets"), F.lit(None).cast("binary")
    listed = going.select("doc_id", F.when(F.col("offsets").isNull(), F.col("print")).alias("whole"), F.when(F.col("offsets").isNotNull(), some).alias("part"), copy.alias("copy"))
    listed = listed.unionByName(copies.select("doc_id", F.lit(None).cast("long").alias("whole"), F.lit(None).cast(listed.schema["part"].dataType).alias("part"), F.col("digest").alias("copy")))
    return stage(listed.groupBy("doc_id").agg(F.collect_set("copy").alias("copies"), F.collect_set("whole").alias("wholes"), F.collect_list("part").alias("parts")), "removals")


def removed(bodies: list[bytes], copies: list[list[bytes]], wholes: pa.Array, parts: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in all of them put together, and what goes of their bytes."""
    size = np.array([len(x) for x in bodies])
    first = np.append(0, np.cumsum(size))
    steps = np.zeros(first[-1] + 1, np.int32)
    lists = lambda x: np.repeat(np.arange(len(bodies)), x.value_lengths().to_numpy(zero_copy_only=False))
    whole = _key(lists(wholes), wholes.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    struct = parts.flatten()
    part_key = _key(lists(parts), struct.field("print").to_numpy(zero_copy_only=False).view(np.uint64))
    offsets = struct.field("offsets")
    part_key = np.repeat(part_key, offsets.value_lengths().to_numpy(zero_copy_only=False))
    by = np.argsort(part_key, kind="stable")
    part_key, part_at = part_key[by], offsets.flatten().to_numpy(zero_copy_only=False)[by]

    def mark(begin: np.ndarray, end: np.ndarray) -> None:
        np.add.at(steps, begin, 1)
        np.add.at(steps, end, -1)

    for of, start, runs, _, prints in described(bodies, span):
        key, begin = _key(of, prints), first[of] + start
        all_ = np.isin(key, whole)
        mark(begin[all_], (begin + runs + span - 1)[all_])
        low, high = np.searchsorted(part_key, key, "left"), np.searchsorted(part_key, key, "right")
        some = np.flatnonzero((high > low) & ~all_)
        n = (high - low)[some]
        at = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        windows = np.repeat(begin[some], n) + part_at[at]
        mark(windows, windows + span)
    for k, mine in enumerate(copies):
        if mine and xxhash.xxh3_128_digest(bodies[k]) in mine:
            mark(first[k : k + 1], first[k + 1 : k + 2])
    return first, np.cumsum(steps[:-1]) > 0


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, starts and ends (the maximal runs that go, in bytes), kept (the bytes that stay)."""
    if span < TOKEN + 8:
        raise ValueError(f"span must be {TOKEN + 8} or more")
    bound_batches(docs.sparkSession)
    lists = removals(docs, span)
    ids = stage(lists.select("doc_id"), "touched")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [x or b"" for x in b.column(1).to_pylist()]
            first, gone = removed(bodies, b.column(2).to_pylist(), b.column(3), b.column(4), span)
            data = np.frombuffer(b"".join(bodies), np.uint8)
            edge = gone.view(np.int8)
            # Runs end with their text: copies that follow each other are runs of their own.
            starts = np.flatnonzero(np.diff(edge, prepend=0) == 1)
            starts = np.union1d(starts, first[:-1][np.append(edge, 0)[first[:-1]] == 1]).astype(np.int64)
            ends = np.flatnonzero(np.diff(edge, append=0) == -1) + 1
            ends = np.union1d(ends, first[1:][np.append(0, edge)[first[1:]] == 1]).astype(np.int64)
            own = np.searchsorted(first[1:], starts, "right")
            offsets = pa.array(np.searchsorted(own, np.arange(len(b) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x - first[own])) for x in (starts, ends)]
            kept = [data[i:j][~gone[i:j]].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield batch(schema, b.column(0), np.diff(first), *lists, kept)

    touched = text_bytes(by_ids(docs, ids, "left_semi")).join(lists, "doc_id").mapInArrow(lean(run, "powers", forget_powers), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    none = F.array().cast("array<long>")
    rest = text_bytes(by_ids(docs, ids, "left_anti")).select("doc_id", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.coalesce("body", F.lit(b"")).alias("kept"))
    return rest.unionByName(touched)


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    found = dedup(docs, span)
    gone = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
