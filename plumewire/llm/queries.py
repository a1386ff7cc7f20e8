"""The queries of the numbered operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, langid, linededup, minhash, mixing, quality, secrets, spelling, suffixes, tokenfile, trie, warc
from .common import read_table


def op1_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.texts(read_table(spark, sf_dir, "pages"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read_table(spark, sf_dir, "pages")))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.measure(docs).drop("rejected_by")


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    models = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, models)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(read_table(spark, sf_dir, "documents"))


#: Shares of the domains that the mixing query aims at.
MIX = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(read_table(spark, sf_dir, "labels"))
    return mixing.rates(read_table(spark, sf_dir, "documents"), labels, MIX)


def op9_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op10_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(read_table(spark, sf_dir, "documents"), width=4)


def op11_wildcard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_block_labeller, op2_warc_derivatives, op3_quality_cascade, op4_wu_manber, op5_line_dedup, op6_language_id, op7_token_codes, op8_soft_mixing, op9_credential_links, op10_minhash_tensor, op11_wildcard_groups, op12_suffix_dedup, op13_prefix_trie)}
