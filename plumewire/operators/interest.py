"""Interest ranking: log-odds weights of words from readers' choices, and scores of new articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_EXAMPLES, TOP = 10, 2000


def train(examples: DataFrame, top: int = TOP, least: int = MIN_EXAMPLES) -> DataFrame:
    """(term, weight): the ``top`` words by size of the log-odds between liked and passed articles (to nine digits, ties by
    word), with one added to each count and two to each class; none with fewer than ``least`` examples of a class.
    examples: id, liked, terms (distinct words)."""
    size = examples.agg(F.count_if("liked").alias("pos"), F.count_if(~F.col("liked")).alias("neg"))
    df = examples.select("liked", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count_if("liked").alias("p"), F.count_if(~F.col("liked")).alias("n"))
    x = df.crossJoin(F.broadcast(size)).where((F.col("pos") >= least) & (F.col("neg") >= least))  # one row
    weight = F.log((F.col("p") + 1) / (F.col("pos") + 2)) - F.log((F.col("n") + 1) / (F.col("neg") + 2))
    return x.select("term", weight.alias("weight")).orderBy(F.desc(F.round(F.abs("weight"), 9)), "term").limit(top)


def score(articles: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, score): the mean weight of an article's known words, 0 without any."""
    terms = articles.select("id", F.explode(F.array_distinct("terms")).alias("term"))
    known = terms.join(F.broadcast(weights), "term").groupBy("id").agg(F.avg("weight").alias("score"))  # at most TOP words
    return articles.select("id").join(known, "id", "left").fillna(0.0, ["score"])


def ranked(groups: DataFrame, scores: DataFrame, members: DataFrame, newest: int = 300) -> DataFrame:
    """The newest groups by their best member's score, then outlets, then id."""
    recent = groups.orderBy(F.desc("last_seen_at"), F.desc("group_id")).limit(newest)
    best = members.join(scores, "id").groupBy("group_id").agg(F.max("score").alias("score"), F.count_distinct("media_id").alias("outlets"))
    return recent.join(best, "group_id").orderBy(F.desc("score"), F.desc("outlets"), F.desc("group_id"))
