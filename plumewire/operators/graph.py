"""Node and edge tables of a story's or a name's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.text import clean_space, norm


def story_graph(members: DataFrame, relations: DataFrame, posts: DataFrame, articles_max: int = 60, names_max: int = 8, posts_max: int = 15) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every group.  members: group_id, id, title, ents, first_seen_at; relations: group_id, a, b,
    relation_type; posts: group_id, post_id, article_id.  Only explicit references have a direction."""
    w = lambda *order: Window.partitionBy("group_id").orderBy(*order)
    art = members.withColumn("place", F.row_number().over(w("first_seen_at", "id"))).where(F.col("place") <= articles_max)
    names = art.select("group_id", "id", F.explode("ents").alias("name"))
    top = names.groupBy("group_id", "name").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w(F.desc("n"), "name"))).where(F.col("place") <= names_max)
    shown = posts.withColumn("place", F.row_number().over(w("post_id", "article_id"))).where(F.col("place") <= posts_max)
    node = lambda df, kind, key, label: df.select("group_id", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"))
    nodes = node(art, "article", "id", "title").unionByName(node(top, "name", "name", "name")).unionByName(node(shown, "post", "post_id", "post_id").distinct())
    edge = lambda df, kind, a, b, directed: df.select("group_id", F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), directed.alias("directed"))
    inside = relations.join(art.select("group_id", F.col("id").alias("a")), ["group_id", "a"], "left_semi").join(art.select("group_id", F.col("id").alias("b")), ["group_id", "b"], "left_semi")
    edges = edge(inside, F.col("relation_type"), "a", "b", F.col("relation_type") == "referencia_explicita")
    edges = edges.unionByName(edge(names.join(top.select("group_id", "name"), ["group_id", "name"], "left_semi"), "names", "id", "name", F.lit(False)))
    return nodes, edges.unionByName(edge(shown, "post", "post_id", "article_id", F.lit(True)))


def display_names(texts: DataFrame) -> DataFrame:
    """name, shown: how each folded name is written most often (ties: the form that comes first by id), over all texts.
    A single word counts where a text has it after its beginning: there the capital says that it is a name.
    texts: id, text."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(L.ENTITY), F.lit(1))
    starts = F.coalesce("text", F.lit("")).rlike("^" + L.ENTITY)
    each = texts.select("id", starts.alias("starts"), F.posexplode(found).alias("k", "raw")).select("id", clean_space(F.col("raw")).alias("shown"), (F.col("starts") & (F.col("k") == 0)).alias("first"))
    sure = each.where(~F.col("first") | F.contains("shown", F.lit(" "))).withColumn("name", norm(F.col("shown")))
    forms = sure.groupBy("name", "shown").agg(F.count("*").alias("n"), F.min("id").alias("at"))
    return forms.groupBy("name").agg(F.min_by("shown", F.struct((-F.col("n")).alias("n"), "at", "shown")).alias("shown"))


def with_display_names(nodes: DataFrame, shown: DataFrame, column: str = "key", label: str = "label") -> DataFrame:
    """Nodes whose names are written as the corpus writes them; a name that it writes nowhere stays folded."""
    found = shown.select(F.col("name").alias(column), F.col("shown").alias("_shown"))
    return nodes.join(found, column, "left").withColumn(label, F.coalesce("_shown", label)).drop("_shown")


def name_graph(articles: DataFrame, name: str, top: int = 20) -> DataFrame:
    """source, target, n: the names beside ``name`` and how often they are together."""
    mine = articles.where(F.array_contains("ents", name)).select(F.explode("ents").alias("other")).where(F.col("other") != name)
    return mine.groupBy(F.lit(name).alias("source"), F.col("other").alias("target")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(top)
