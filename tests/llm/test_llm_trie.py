"""The conversation trie against one that is built turn by turn."""

import hashlib
import random
import zlib

from plumewire.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t, key=lambda x: x[:3])] for c, t in said.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path)))
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1]) if node else 0
        leaves = sum(below[k][0] for k in kids.get(node, [])) or 1
        saved = (len(members[node]) - 1) * size + sum(below[k][1] for k in kids.get(node, []))
        below[node] = (leaves if kids.get(node) else 1, saved)
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in found if n == len(node)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in found), len(node), parent, len(found), len(kids.get(node, [])), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(map(tuple, trie.trie(table).select(*COLUMNS).collect()))


def talks(seed=1, convs=150, ids=range(0, 700)):
    r = random.Random(seed)
    said = [r.choice(["Hello", "héllo", "", None, "What is it?", "日本"]) for _ in range(6)]
    rows = []
    for c in r.sample(list(ids), convs):
        for t in range(r.randint(1, 9)):
            rows.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", "assistant", None]), r.choice(said)))
    return rows


def test_against_a_tree(spark):
    """Shared beginnings, missing first conversations, short ones that lose all their turns, ties, nulls, repeated rows."""
    rows = talks()
    rows += [x for x in talks(2, 5, range(0, 700, 100))] + rows[:40] + [(None, 1, "user", "lost"), (-5, 1, "user", "Hello"), (-250, 2, None, None), (-200, 1, "user", "Hello"), (10**15 + 7, 0, "user", "far")]
    want = brute_trie(rows)
    assert len(want) > 150 and any(w[4] > 3 for w in want) and any(w[2] is not None and w[2] != w[0] for w in want)
    assert run(spark, rows) == want


def test_one_very_long_conversation(spark):
    """Longer than a block of turns, over several ranges, and most rows of the table."""
    rows = [(200, t, "user", f"turn {t % 7}") for t in range(2600)] + [(201, t, "user", f"turn {t % 7}") for t in range(1500)] + talks(3, 40)
    assert run(spark, rows) == brute_trie(rows)


def test_many_equal_conversations(spark):
    """A very common first turn and a very common conversation: ids over several blocks end at one node."""
    rows = [(c, t, "user", f"same {t}") for c in range(9000, 15_000) for t in range(6)] + [(c, 6, "user", f"own {c}") for c in range(9000, 9300)]
    assert run(spark, rows) == brute_trie(rows)


def test_empty_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, 1, "user", "a", 5, 5, 5, "s"), (2, 1, "user", "a", 6, 6, 6, "s")], "conv_id long, turn long, role string, text string, depth long, x1 long, part long, said string")
    assert trie.trie(table.limit(0)).count() == 0
    assert sorted(map(tuple, trie.trie(table).select(*COLUMNS).collect())) == brute_trie([(1, 1, "user", "a"), (2, 1, "user", "a")])


def test_all_turns_lost(spark):
    """Conversations without a turn are members of the root alone."""
    rows = [(c, 1, "user", "a") for c in range(301, 330)]
    want = brute_trie(rows)
    assert run(spark, rows) == want and any(w[1] == 0 and w[7] != hashlib.sha256(b"").hexdigest() for w in want)
