"""Suffix dedup against a plain dictionary of windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from plumewire.llm import suffixes


def brute_removed(rows, span=50):
    owner = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        if i is not None:
            for k in range(len(b) - span + 1):
                w = b[k : k + span]
                owner[w] = min(owner.get(w, i), i)
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - span + 1):
                if owner[b[k : k + span]] < i:
                    gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed=3):
    """Passages at the start, the end and in the middle, of just under, exactly and over the length; edited copies; a text
    that repeats itself; many texts with one passage."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé日") for _ in range(r.randint(2, 7))) for _ in range(500)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = some(60)
    out = []
    for k in range(80):
        a, b = some(r.randint(0, 40)), some(r.randint(0, 40))
        cut = r.randrange(1, 40)
        part = passage[cut : cut + r.choice([20, 46, 47, 48, 49, 50, 51, 52, 60, 150, 300])]
        out.append((1000 - k, r.choice([a + part + b, part + b, a + part, part, a + b, a + part + b + part, passage + passage + a])))
    base = list(some(150))
    for k in range(30):
        near = list(base)
        for _ in range(3):
            near[r.randrange(len(near))] = "#"
        out.append((2000 + k, "".join(near)))
    out += [(3000, "ab" * 400), (3001, "ab" * 300), (3002, "x" * 900), (3003, "x" * 49), (3004, "x" * 50), (3005, "y" * 2000), (3006, "".join(base)), (3007, "".join(base))]
    out += [(None, "".join(base)), (None, passage), (3008, None), (3009, ""), (5, passage), (5, passage), (5, some(30)), (6, passage + "!" * 60), (4, some(20_000)), (7, "é" * 60)]
    return out


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_against_all_windows(spark):
    rows = rows_of()
    want = brute_removed(rows)
    assert sum(w[2] > 0 for w in want) > 60 and any(w[3] > 1 for w in want) and any(w[2] == w[1] > 0 for w in want)
    assert collected(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_split_tokens_and_small_chunks(spark, monkeypatch):
    """Every frequent token is split over buckets, and buckets are cut everywhere: windows are compared across."""
    monkeypatch.setattr(suffixes, "SPLIT", 0)
    monkeypatch.setattr(suffixes, "CHUNK", 400)
    monkeypatch.setattr(suffixes, "CHUNK_ROWS", 3)
    rows = [(i, t) for i, t in rows_of(4) if i != 4]
    assert collected(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_removed(rows)


@pytest.mark.parametrize("span", [32, 70])
def test_other_lengths(spark, span):
    rows = [(i, t) for i, t in rows_of(6) if i != 4]
    assert collected(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string"), span)) == brute_removed(rows, span)


def test_odd_rows_and_empty(spark, docs, plain, empty):
    assert collected(suffixes.report(docs)) == brute_removed(plain)
    assert suffixes.report(empty).count() == 0
    assert collected(suffixes.report(docs.unionByName(docs))) == brute_removed([*plain, *plain])


def test_spans_are_where_bytes_go(spark):
    rows = [(1, "a shared passage that is rather longer than the fifty bytes needed"), (2, "before; a shared passage that is rather longer than the fifty bytes needed; after")]
    got = {r.doc_id: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].starts, got[2].ends, bytes(got[2].kept)) == ([8], [74], b"before; ; after") and got[1].starts == []


def test_fragments_tile_the_windows():
    """Equal windows have equal tokens, equal fragments equal digests, and each window is in one fragment; long texts too."""
    bodies = [t.encode() for i, t in rows_of(8) if t] + [b"q" * (suffixes.PIECE + 700), bytes(random.Random(1).choices(b"abc", k=suffixes.PIECE + 90))]
    bodies = [b for b in bodies if len(b) >= 50]
    token, digest, n = {}, {}, 0
    for of, start, runs, tokens, prints in suffixes.described(bodies, 50):
        for k, s, c, t, p in zip(of.tolist(), start.tolist(), runs.tolist(), tokens.tolist(), prints.tolist()):
            n += c
            assert c <= suffixes.LONGEST
            for w in range(s, s + c, 7):
                assert token.setdefault(bodies[k][w : w + 50], t) == t
            assert digest.setdefault(bodies[k][s : s + c + 49], p) == p
    assert n == sum(len(b) - 49 for b in bodies) and len(set(digest.values())) == len(digest)


def test_multikey_quicksort_finds_equal_windows():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 900, dtype=np.uint8).tobytes()
    at = np.arange(len(data) - 19)
    order, new = suffixes.sorted_ties(data, at, 20)
    runs = np.split(order, np.flatnonzero(new)[1:]) if len(order) else []
    got = sorted(sorted(at[x].tolist()) for x in runs)
    where = {}
    for p in at.tolist():
        where.setdefault(data[p : p + 20], []).append(p)
    assert got == sorted(x for x in where.values() if len(x) > 1)


def test_chunks_are_cut_between_tokens():
    tokens = [1] * 3 + [2] * 9 + [3] * 2 + [4] * 5
    batches = [pa.record_batch({"token": pa.array(tokens[i : i + 2], pa.int64())}) for i in range(0, len(tokens), 2)]
    seen, where = [], {}
    for k, (table, cut) in enumerate(suffixes._chunks(iter(batches), len, 4)):
        own = table["token"].to_pylist()
        seen += own
        for t in set(own):
            where.setdefault(t, []).append(t in cut)
    assert seen == tokens
    for t, cuts in where.items():
        assert len(cuts) == 1 or all(cuts), t


def test_splitters_split_only_large_tokens():
    tokens = list(range(100)) + [500] * 300
    cuts, split = suffixes.splitters(tokens, 8, 400)
    assert list(split) == [] and len(cuts) == 7
    cuts, split = suffixes.splitters(tokens, 8, 400 * suffixes.SPLIT)
    assert list(split) == [500]
    found = suffixes.bucket_of(np.array([500] * 200 + [3]), np.arange(201), cuts, split)
    assert len(set(found[:200].tolist())) > 3 and found[200] < found[:200].min() + 1
