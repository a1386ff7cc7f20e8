"""The domain tables as views over the provided ones, in Spark; ``sql.py`` has the same in SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import dealt_finely

TOPICS = [("agua", ["the water", "tion"], []), ("tierra", ["erin", "la"], ["der"]), ("aire", ["der", "und"], []), ("fuego", ["de la", "los"], ["the"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first twelve words are the title, times are spread over January 2024."""
    d = table(spark, sf_dir, "documents")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 7919 % 43200).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("media_id"), F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 12), " ").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.col("text").alias("body"), "lang",
        (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("first_seen_at"), (F.col("doc_id") % 10 == 0).alias("is_syndicated"), F.lit(False).alias("is_demo"),
    )


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "slug string, keywords array<string>, exclude array<string>")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as members of story groups: the order is the group, the supplier's nation the outlet."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    dealt_finely(spark, line.count())
    both = line.join(orders, line.l_orderkey == orders.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return both.select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("s_nationkey").alias("media_id"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("published_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("first_seen_at"), (F.col("l_linenumber") == 4).alias("is_syndicated"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as headline versions: the user is the article, the event's type its source, the value its text."""
    e = table(spark, sf_dir, "events")
    level = F.floor(F.col("value") / 40)
    title = F.concat(F.lit("Precio "), F.when(level % 3 == 0, "no ").otherwise(""), F.lit("sube "), level.cast("string"), F.lit(" puntos en la ciudad"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("article_id"), F.col("event_type").alias("subsource_id"), title.alias("title"), F.lit(None).cast("string").alias("subtitle"), F.col("ts").alias("detected_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.col("event_type").alias("run_type"), (F.col("user_id") % 7).alias("scope"), F.when(F.col("event_type") != "error", "ok").otherwise("error").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("items"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "error"), "impresion").when(F.col("event_type") == "click", "detalle").when(F.col("event_type") == "purchase", "original").otherwise("ocultar")
    return e.select((F.col("event_id") % 40).alias("article_id"), (F.col("user_id") % 20).alias("user_id"), kind.alias("event"), F.get_json_object("props", "$.k").cast("long").alias("rank"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' labels on documents: the stratum is the size of the text."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    stratum = F.when(F.col("n_chars") < 700, "corta").when(F.col("n_chars") < 2500, "media").otherwise("larga")
    votes = F.array(F.when(F.col("quality") == 1, "correcta").otherwise("incorrecta"), F.when(F.col("toxic") == 1, "incorrecta").otherwise("correcta"), F.when(F.col("doc_id") % 3 == 0, "dudosa").otherwise("correcta"))
    return joined.select(F.col("doc_id").alias("item"), stratum.alias("stratum"), F.when(stratum == "media", 400).otherwise(150).alias("sample_population"), F.explode(votes).alias("label"))
