"""Prefix trie of conversations, by smallest members and without walking a tree.

A node is a sequence of first turns; its name is its depth and two 64-bit digests, the exclusive or of mixed (place, turn)
pairs so far.  Each conversation has a row for each node on its path.  A node belongs to its smallest member; who owns a
node owns all further ones on its own path, so a conversation owns a suffix of its path (or nothing), which starts where
the smallest depth of its nodes says.  That turns sums over subtrees into one group-by of prefixes: each member adds the
tokens on its path from the node on (all occurrences) less those that it owns, and a mark if it owns a leaf, so that each
node below counts with its occurrences less one, and each leaf once.

Windows run along the paths for places and prefixes.  A conversation may hold a third of all turns: its rows are dealt by
ranges over several tasks, windows run inside the ranges, and totals of the ranges before (a few rows for each range, not
for each conversation) are added.  Facts about a conversation meet its rows by blocks of ``BLOCK`` turns, and nodes with
very many children meet them dealt over several tasks.

Defined results: rows with a null conv_id belong to no conversation; a null turn comes first, null roles and texts are
empty; ties in turn go by the MD5 of role and text (repeated rows are turns of their own); a very long text is one turn;
an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bound_batches, lean, shuffle_width, stage
from .minhash import _meet

#: Conversations that take their first turns from the same one, and so many of those at most.
TEAM, HEAD = 100, 5
#: Turns of a conversation that meet its facts together (a power of two), and ids whose text is made at once.
BLOCK, IDS = 1024, 4096

_KEY = ["depth", "x1", "x2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (MD5 of role and text), size (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.length(text).cast("long").alias("size"))


def running(rows: DataFrame, order: list[str], totals: dict[str, tuple[Column, str]], name: str) -> DataFrame:
    """``rows`` (a stage table) with running totals along each conversation, this row included.  totals: name -> (column, sum or
    bit_xor).  Rows are dealt by ranges, so that a long conversation is several tasks' work."""
    dealt = rows.select("*", *(c.alias(f"own_{k}") for k, (c, _) in totals.items())).repartitionByRange(shuffle_width(rows.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = stage(dealt.select("*", *(getattr(F, how)(f"own_{k}").over(inside).alias(k) for k, (_, how) in totals.items())), name)
    parts = held.groupBy("conv_id", "part").agg(*(getattr(F, how)(f"own_{k}").alias(f"all_{k}") for k, (_, how) in totals.items()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "part", *(getattr(F, how)(f"all_{k}").over(before).alias(f"all_{k}") for k, (_, how) in totals.items())).where(" and ".join(f"all_{k} is not null" for k in totals))
    # A range begins inside one conversation at most, so this has fewer rows than there are ranges.
    met = held.join(F.broadcast(stage(carried, "carried")), ["conv_id", "part"], "left")
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    return met.select(*rows.columns, *(add[how](F.col(k), F.coalesce(f"all_{k}", F.lit(0))).alias(k) for k, (_, how) in totals.items()))


def _beside(rows: DataFrame, facts: DataFrame, at: str, last: str) -> DataFrame:
    """``rows`` with the facts of their conversation, which are copied for each block of its rows.  at: place of a row;
    last: the greatest place."""
    block = lambda c: F.shiftright(F.col(c), BLOCK.bit_length() - 1)
    copied = facts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(last))))
    return rows.withColumn("block", block(at)).join(copied, ["conv_id", "block"]).drop("block")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id), and (conv_id, depth, said, size): every conversation's turns after its first ones are exchanged for those
    of the first conversation of its team."""
    rows = stage(turns(conversations), "turns")
    placed = stage(running(rows, ["turn", "said"], {"place": (F.lit(1).cast("long"), "sum")}, "placed"), "places")
    convs = placed.groupBy("conv_id").agg(F.max("place").alias("n"))
    share = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    convs = convs.select("conv_id", "n", share.alias("h"), (F.col("conv_id") - F.col("conv_id") % TEAM).alias("base"))
    has = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage(convs.join(has, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    heads = placed.where(F.col("place") <= HEAD).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "said", "size")
    given = convs.select("conv_id", "base", "h").join(heads, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "said", "size")
    own = _beside(placed, convs.select("conv_id", "n", "h", "taken"), "place", "n").where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "said", "size")
    return convs.select("conv_id"), stage(given.unionByName(own), "rebuilt")


def paths(convs: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (node), p1, p2 (its parent), size, before (tokens of the path before the node): a row for
    each node on each path, the root included."""
    # The constants tell the two digests apart.
    marks = [F.xxhash64(F.lit(k), "depth", "said") for k in (1, 2)]
    summed = running(said, ["depth"], {"x1": (marks[0], "bit_xor"), "x2": (marks[1], "bit_xor"), "tokens": (F.col("size"), "sum")}, "prefixes")
    nodes = summed.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(marks[0]).alias("p1"), F.col("x2").bitwiseXOR(marks[1]).alias("p2"), "size", (F.col("tokens") - F.col("size")).alias("before"))
    zero = F.lit(0).cast("long")
    return nodes.unionByName(convs.select("conv_id", *(zero.alias(c) for c in nodes.columns[1:])))


def _digests(ends: DataFrame) -> DataFrame:
    """Node and SHA-256 of the ids of the conversations that end there.  Ids become texts in blocks of ``IDS`` numbers; a
    node's texts pass through one digest in order, one at a time."""
    pieces = ends.withColumn("block", F.shiftright("conv_id", IDS.bit_length() - 1)).groupBy(*_KEY, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for b in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(c.to_pylist() for c in b.columns)):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield batch(schema, *(list(c) for c in zip(*out)))
        if now is not None:
            yield batch(schema, *([c] for c in (*now, digest.hexdigest())))

    ordered = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")
    return ordered.mapInArrow(lean(run), "depth long, x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for
    each node of the trie of the rebuilt conversations."""
    bound_batches(conversations.sparkSession)
    convs, said = rebuilt(conversations)
    rows = stage(paths(convs, said), "paths")
    nodes = stage(rows.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = nodes.where("depth > 0").select(*parent).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # A conversation owns its path from the smallest depth of its nodes on; shared: the tokens before that.
    lasts = rows.groupBy("conv_id").agg(F.max("depth").alias("last"), F.max(F.col("before") + F.col("size")).alias("total"))
    starts = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("depth"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    shared = starts.join(rows.select("conv_id", "depth", "before"), ["conv_id", "depth"]).select("conv_id", "leaf", F.col("before").alias("shared"))
    facts = stage(lasts.join(shared, "conv_id", "left").select("conv_id", "last", F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"), F.coalesce("shared", "total").alias("shared")), "owned")
    # Occurrence tokens from the node on, less the owned ones: those between the node and where ownership starts.
    beyond = F.greatest(F.col("shared") - F.col("before"), F.lit(0).cast("long"))
    sums = _beside(rows, facts, "depth", "last").groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(beyond).alias("saved_tokens"))
    ends = rows.join(facts.select("conv_id", F.col("last").alias("depth")), ["conv_id", "depth"]).select(*_KEY, "conv_id")

    # The parent's owner is the node's own, but where the owner's suffix starts.
    first = nodes.join(starts.select(F.col("conv_id").alias("owner"), F.col("depth")), ["owner", "depth"]).where("depth > 0")
    asked = stage(first.select(F.struct(*parent).alias("parent"), *_KEY, "owner"), "asked")
    known = nodes.select(F.struct(*_KEY).alias("parent"), F.col("owner").alias("parent_conv_id"))
    above = _meet(asked, known, "parent", "owner").select(*_KEY, "parent_conv_id")
    out = nodes.join(above, _KEY, "left").join(sums, _KEY).join(_digests(ends), _KEY, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "owner")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
