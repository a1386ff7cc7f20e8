"""Streaming forms of the stateful operators.  Event times are cast to TIMESTAMP, as watermarks need them so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """key, start, n in tumbling windows; late events within ``late`` count."""
    e = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    out = e.groupBy(F.window("at", length).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sliding_counts(events: DataFrame, time: str, key: str, length: str = "72 hours", step: str = "24 hours", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    out = e.groupBy(F.window("at", length, step).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(events: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """One event for each key and day; the day is part of the key, so that a later day's event is not dropped."""
    e = events.withColumn("at", F.col(time).cast("timestamp")).withColumn("day", F.to_date("at")).withWatermark("at", late)
    return e.dropDuplicatesWithinWatermark([*key, "day"])


def headline_versions(items: DataFrame) -> DataFrame:
    """A row for each version of a headline that differs from the last one kept for its article and source.  State: the
    last hash and the version's number.  items: article_id, subsource_id, hash, title, at (TIMESTAMP)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, number = state.get if state.exists else ("", 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["at", "hash"]).itertuples():
            if r.hash != last:
                last, number = r.hash, number + 1
                out.append((key[0], key[1], number, r.title, r.at))
        state.update((last, number))
        yield pd.DataFrame(out, columns=["article_id", "subsource_id", "version", "title", "at"])

    return items.groupBy("article_id", "subsource_id").applyInPandasWithState(run, "article_id long, subsource_id string, version long, title string, at timestamp", "last string, number long", "append", GroupStateTimeout.NoTimeout)


def merged_into(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is merged with the last table and written as a new one, named after the batch.
    A batch that runs again starts from the same table and writes the same one."""

    def run(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/v={number - 1}") if number else None
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return run
