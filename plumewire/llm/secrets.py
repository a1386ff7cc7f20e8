"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong kinds are reported as they are: ``assign`` (a named value), ``access`` (an access key id) and ``hex`` (a
long hexadecimal run).  Weak parts - an identifier (``ident``), a secret-like run (``part``) and an
``endpoint`` - are reported only where complementary parts lie within ``scope`` characters: a part needs an
identifier, an identifier needs a secret, an endpoint needs both.  The intervals are joined by a sweep: ordered
by position, each span sees the nearest complementary end before it and start after it, so the work is in
proportion to the spans and no pairs are made.

What belongs together is reported too: each secret with its nearest identifier within the scope, and its nearest
endpoint there, if any (``links``).

Positions are code points, end exclusive; matches of a kind are leftmost and do not overlap.

Defined results: a null or empty text has no spans; a very long text is searched whole; of two identifiers at one
distance (a tie) the one before the secret is linked; repeated rows give repeated results (``links``: one result, as
they are one document); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCOPE = 160
#: Kinds in reporting order.
KINDS = ("assign", "access", "hex", "ident", "part", "endpoint")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "ident": r"(?i)(?:user_?name|user|login|client_?id|account_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}",
    "part": r"[A-Za-z0-9+/]{24,}",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?",
}


def _holds(kind: str, match: Column) -> Column:
    """What a match must have besides the pattern."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8
    if kind == "part":  # secret-like: digits and letters of both cases
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _matches(kind: str) -> Column:
    """For each match its kind, place, the length of the text since the last match, its own length, and its validity."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.split("text", PATTERNS[kind], -1)
    return F.transform(
        found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.element_at(gaps, i + 1)).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), _holds(kind, m).alias("ok"))
    )


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h (hash of the text), copies, kind, begin, finish: the reported spans; documents without any have
    one row with a null kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("h"), F.flatten(F.array(*map(_matches, KINDS))).alias("m"))
    found = found.groupBy("doc_id", "h").agg(F.count("*").alias("copies"), F.first("m").alias("m"))
    flat = found.select("doc_id", "h", "copies", F.explode_outer("m").alias("m")).select("doc_id", "h", "copies", "m.*")
    key = ["doc_id", "h"]
    before = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    finish = F.sum(F.col("gap") + F.col("len")).over(before)
    placed = flat.withColumn("finish", finish).withColumn("begin", F.col("finish") - F.col("len")).withColumn("kind", F.when(F.col("ok"), F.col("kind")))  # rows stay, so that no document is lost
    kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    is_ident = kind["access"] | kind["ident"]
    is_secret = kind["assign"] | kind["hex"] | kind["part"]
    up = Window.partitionBy(*key).orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*key).orderBy(F.desc("begin"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(is_part: Column) -> Column:
        last = F.max(F.when(is_part, F.col("finish"))).over(up)
        after = F.min(F.when(is_part, F.col("begin"))).over(down)
        return F.coalesce(F.col("begin") - last <= scope, F.lit(False)) | F.coalesce(after - F.col("finish") <= scope, F.lit(False))

    strong = kind["assign"] | kind["access"] | kind["hex"]
    covered = F.coalesce(F.max(F.when(strong, F.col("finish"))).over(up) > F.col("begin"), F.lit(False)) | F.coalesce(F.min(F.when(strong, F.col("begin"))).over(down) < F.col("finish"), F.lit(False))
    report = strong | ~covered & F.when(kind["part"], near(is_ident)).when(kind["ident"], near(is_secret)).when(kind["endpoint"], near(is_ident) & near(is_secret))
    return placed.withColumn("report", report).select(*key, "copies", F.when(F.col("report"), F.col("kind")).alias("kind"), "begin", "finish")


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """The spans with ``ident`` and ``endpoint`` (kind, begin, finish; null but for secrets): the nearest reported ones."""
    kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    key = ["doc_id", "h"]
    up = Window.partitionBy(*key).orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*key).orderBy(F.desc("begin"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    secret = kind["assign"] | kind["hex"] | kind["part"]

    def nearest(wanted: Column) -> Column:
        before = F.max(F.when(wanted, F.struct("finish", "begin", "kind"))).over(up)
        after = F.min(F.when(wanted, F.struct("begin", "kind", "finish"))).over(down)
        left, right = F.col("begin") - before["finish"], after["begin"] - F.col("finish")
        same = lambda x: F.struct(x["kind"].alias("kind"), x["begin"].alias("begin"), x["finish"].alias("finish"))
        near = lambda gap: F.coalesce(gap <= scope, F.lit(False))
        return F.when(secret & near(left) & (~near(right) | (left <= right)), same(before)).when(secret & near(right), same(after))

    return found.withColumns({"ident": nearest(kind["access"] | kind["ident"]), "endpoint": nearest(kind["endpoint"])})


def _named(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["begin"].cast("string"), x["finish"].cast("string"))


def links(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, secret, ident, endpoint (each kind:begin:end; endpoint may be null): one row for each secret that has
    an identifier within the scope."""
    whole = F.struct("kind", "begin", "finish")
    found = _linked(spans(docs, scope), scope).where("ident is not null")
    return found.select("doc_id", _named(whole).alias("secret"), _named(F.col("ident")).alias("ident"), F.when(F.col("endpoint").isNotNull(), _named(F.col("endpoint"))).alias("endpoint"))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, links (identifier+secret+endpoint by the secret's place)."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("begin", "kind", "finish", "ident", "endpoint"))))
    got = _linked(spans(docs, scope), scope).groupBy("doc_id", "h").agg(F.first("copies").alias("copies"), ordered.alias("s"))
    text = lambda items: F.array_join(F.transform(items, _named), ",")
    link = lambda x: F.concat(_named(x["ident"]), F.lit("+"), _named(x), F.when(x["endpoint"].isNotNull(), F.concat(F.lit("+"), _named(x["endpoint"]))).otherwise(""))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    out = got.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), text(F.col("s")).alias("spans"),
        F.array_join(F.transform(F.filter("s", lambda x: x["ident"].isNotNull()), link), ",").alias("links"), "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
