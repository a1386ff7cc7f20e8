"""A training-data pipeline from five of the corpus operators; each stage is written and read again.

Every stage takes null texts, null ids, repeated rows, very long texts, empty tables and further columns of any name;
what it does with them is said below and, in full, in the operator's module."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumewire.llm import decontam, minhash, mixing, quality, tokenfile
from plumewire.llm.common import at_the_end, dropping_stages, read_table, remove, shared_dir, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and with them null and empty texts, which have too few words.  Repeated rows are judged one
    by one; further columns stay."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, repeated rows included.  A document without words is no copy."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.  An empty benchmark, or a null text, has no window."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The domains come as near to the shares ``WEIGHTS`` of the expected tokens as rates up to one allow, with clean text
    whole: toxic documents go, low ones are thinned by chance, none comes twice.  No labels: all stay.  A text of null is a
    document without tokens."""
    return mixing.blend(docs, mixing.quality_domains(read_table(spark, sf_dir, "labels")), WEIGHTS, "clean")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in directly addressable codes; one row a document, read back from them.  A null text has the end
    id alone; of further columns only doc_id is left."""
    return tokenfile.round_trip(docs)


#: Target shares of the domains' expected tokens.
WEIGHTS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}

STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]

#: Near-duplicate groups, the fitted rates and the token files have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its table, which goes with the session; the tables before it go as soon as the next
    one is written."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/plumewire/pipeline-{uuid.uuid4().hex}"
    path = None
    for name, made in STAGES:
        before, path = path, f"{folder}/{name.replace(' ', '-')}"
        with dropping_stages(spark):
            docs = stage(made(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
    at_the_end(spark, path)
    return docs
