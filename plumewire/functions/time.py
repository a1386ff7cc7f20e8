"""Dates and times: naive UTC timestamps, local days and weeks, parsing with an explicit precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "America/Argentina/Buenos_Aires"


def to_local(ts: Column, tz: str = LOCAL) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def to_utc(ts: Column, tz: str = LOCAL) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), ts.cast("timestamp_ntz"))


def local_day(ts: Column, tz: str = LOCAL) -> Column:
    return to_local(ts, tz).cast("date")


def week_start(ts: Column, tz: str = LOCAL) -> Column:
    """The Monday of the local week."""
    return F.date_trunc("week", to_local(ts, tz)).cast("date")


def hours_before(ts: Column, hours: int) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(hours))


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a naive timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def feed_date(raw: Column, tz: str = LOCAL) -> Column:
    """struct(at, day, precision) of a feed's date: ISO, RFC 2822 or a bare date.  An hour is never invented."""
    text = F.trim(raw)
    bare = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text)),
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), "(GMT|UTC|UT)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")),
    )
    naive = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.expr("CAST(NULL AS TIMESTAMP_NTZ)"))
    naive = F.coalesce(naive, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.try_to_timestamp(F.concat(text, F.lit("Z"))).cast("timestamp_ntz")))
    at = F.coalesce(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), zoned.cast("timestamp_ntz")), to_utc(naive, tz))
    return F.struct(F.when(~bare, at).alias("at"), F.when(bare, text.try_cast("date")).otherwise(local_day(at, tz)).alias("day"), F.when(bare & text.try_cast("date").isNotNull(), "date").when(~bare & at.isNotNull(), "datetime").otherwise("none").alias("precision"))


def any_datetime(raw: Column) -> Column:
    """ISO, the old social format, or epoch seconds or milliseconds."""
    number = F.when(raw.rlike(r"^\d{9,14}$"), raw.try_cast("long"))
    epoch = F.when(number > 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.coalesce(epoch, F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(raw)).cast("timestamp_ntz")
