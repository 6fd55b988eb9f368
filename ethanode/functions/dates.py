"""Dates and times as study files write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Time zone names in metadata and the places that stand for them.
ZONES = {"CST": "America/Chicago", "EST": "America/New_York", "MST": "America/Denver", "PST": "America/Los_Angeles"}


def _parsed(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def is_dmy(df: DataFrame, col: str) -> bool:
    """Whether a column's dates are day first: some value reads so, and not all read month first."""
    c = F.col(col)
    got = df.where(c.isNotNull()).agg(F.max(_parsed(c, "d/M/yyyy").isNotNull()).alias("some"), F.min(_parsed(c, "M/d/yyyy").isNotNull()).alias("all")).first()
    return bool(got["some"]) and not bool(got["all"])


def standard_dates(df: DataFrame, col: str) -> DataFrame:
    """`col` as a date, by one decision for the whole column; what does not parse is null."""
    pattern = "d/M/yyyy" if is_dmy(df, col) else "M/d/yyyy"
    return df.withColumn(col, F.coalesce(_parsed(F.col(col), pattern), _parsed(F.col(col), "yyyy-M-d")))


def recorded_time(c: Column) -> Column:
    """A device's time: epoch seconds, or text with an offset (wall clock kept) or without."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    epoch = F.when(text.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(text.cast("double")))
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "yyyy-M-d H:mm")])


def crop_time(date: Column, clock: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), clock), F.lit("yyyy-MM-dd H:mm:ss"))


def utc_offset_hours(date: Column, zone: Column) -> Column:
    """Hours from UTC at the date's midnight in a named zone, daylight saving included."""
    place = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[zone]
    midnight = date.cast("timestamp")
    return (F.unix_timestamp(F.from_utc_timestamp(F.to_utc_timestamp(midnight, place), place)) - F.unix_timestamp(F.to_utc_timestamp(midnight, place))) / 3600.0


def hours(h: Column) -> Column:
    """A number of hours as an interval."""
    return F.make_dt_interval(secs=h * 3600)
