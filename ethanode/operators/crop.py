"""Cropping: by duration, by study times, by temperature, and splitting into days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.functions.dates import crop_time, hours, utc_offset_hours
from ethanode.operators.windows import EPISODE, renumbered, whole


def day_episodes(df: DataFrame, split_time: str = "6:00", ts: str = "ts", name: str = "episode") -> DataFrame:
    """Rows with the day, counted from `split_time`, that they fall in; rows exactly at a split are lost."""
    h, m = (int(x) for x in split_time.split(":"))
    shifted = F.col(ts) - F.expr(f"INTERVAL {h} HOURS {m} MINUTES")
    return df.withColumn("__s", shifted).where(F.date_trunc("day", "__s") != F.col("__s")).withColumn(name, F.date_format("__s", "yyyy-MM-dd")).drop("__s")


def owner_days(df: DataFrame, owner: str = "email", split_time: str = "6:00", ts: str = "ts", name: str = "day") -> DataFrame:
    """`day_episodes` of a recording that several owners share: a slice is one owner's day; rows without an owner are in none."""
    return day_episodes(df.where(F.col(owner).isNotNull()), split_time, ts, name)


def max_duration(df: DataFrame, h: float, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Rows up to h hours after the episode's first, that moment included."""
    return renumbered(df.where(F.col("hours") <= h), keys)


def session_bounds(metadata: DataFrame, first: DataFrame, keys: Sequence[str], begin_adjust_h: float = -0.75, end_adjust_h: float = 0.0, max_duration_h: float = 24.0) -> DataFrame:
    """(keys, begin, end): crop times with their adjustments, else the first reading and the longest duration. `first` has min_ts per episode."""
    begin = crop_time(F.col("crop_begin_date"), F.col("crop_begin_time")) + hours(F.lit(begin_adjust_h))
    end = crop_time(F.col("crop_end_date"), F.col("crop_end_time")) + hours(F.lit(end_adjust_h))
    before_first = F.col("min_ts") - F.expr("INTERVAL 1 MICROSECOND")  # the bounds are exclusive, the first reading stays
    joined = first.join(metadata, list(keys), "left").withColumn("begin", F.coalesce(begin, before_first))
    return joined.select(*keys, "begin", F.coalesce(end, F.col("begin") + hours(F.lit(max_duration_h))).alias("end"), F.col("time_zone"))


def shifted_to_zone(df: DataFrame, upload_zone: str | None, zone_offset: str = "time_zone", date: str | None = None) -> DataFrame:
    """Times moved from the upload's zone to the row's `h:mm` offset; no zone or 999 moves nothing.

    The upload zone's offset is that of the day in the column `date`, or, where that is not
    given or null, of the reading's own day.
    """
    if upload_zone in (None, "999", 999):
        return df
    day = F.to_date("ts") if date is None else F.coalesce(F.col(date).try_cast("date"), F.to_date("ts"))
    base = utc_offset_hours(day, F.lit(upload_zone))
    parts = F.split(F.col(zone_offset), ":")
    sign = F.when(F.col(zone_offset).startswith("-"), -1).otherwise(1)
    own = parts[0].cast("double") + sign * F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(0.0)) / 60
    return df.withColumn("ts", F.col("ts") + hours(F.coalesce(own, base) - base))


def between(df: DataFrame, bounds: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Rows strictly between each episode's begin and end."""
    kept = df.join(bounds.select(*keys, "begin", "end"), list(keys)).where((F.col("ts") > F.col("begin")) & (F.col("ts") < F.col("end")))
    return renumbered(kept.drop("begin", "end"), keys)


def cold_end(df: DataFrame, cutoff: float = 27.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Without a cold tail; cropped_end is the rows cut plus 2, 0 where nothing was to cut.

    Cut where any of the last 6 temperatures is at most the cutoff, unless over 90 % of all
    are under it: rows stay up to the last warm one from idx 6 to n - 6, or to idx 6.
    """
    w = whole(keys)
    n, t = F.count(F.lit(1)).over(w), F.col("temp")
    d = df.withColumn("__n", n)
    d = d.withColumns({
        "__cold": F.max(F.when(F.col("idx") >= F.col("__n") - 6, (t <= cutoff).cast("int"))).over(w) == 1,
        "__mostly": F.avg((F.coalesce(t, F.lit(1e9)) < cutoff).cast("double")).over(w) > 0.9,
        "__last": F.coalesce(F.max(F.when((t > cutoff) & F.col("idx").between(6, F.col("__n") - 6), F.col("idx"))).over(w), F.lit(6)),
    })
    cut = F.coalesce(F.col("__cold"), F.lit(False)) & ~F.col("__mostly")
    d = d.withColumn("cropped_end", F.when(cut, F.greatest(F.col("__n") - 1 - F.col("__last"), F.lit(0)) + 2).otherwise(0).cast("long"))
    return d.where(~cut | (F.col("idx") <= F.col("__last"))).drop("__n", "__cold", "__mostly", "__last")


def cold_start(df: DataFrame, cutoff: float = 27.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Without a cold head, numbered anew; cropped_start is the first row kept plus 1, else 0."""
    w, t = whole(keys), F.col("temp")
    d = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumns({
        "__cold": F.max(F.when(F.col("idx") <= 6, (t <= cutoff).cast("int"))).over(w) == 1,
        "__mostly": F.avg((F.coalesce(t, F.lit(1e9)) < cutoff).cast("double")).over(w) > 0.9,
        "__first": F.min(F.when((t > cutoff) & (F.col("idx") >= 6), F.col("idx"))).over(w),
    })
    d = d.withColumn("__first", F.coalesce("__first", F.col("__n") - 1))
    cut = F.coalesce(F.col("__cold"), F.lit(False)) & ~F.col("__mostly")
    d = d.withColumn("cropped_start", F.when(cut, F.col("__first") + 1).otherwise(0).cast("long"))
    return renumbered(d.where(~cut | (F.col("idx") >= F.col("__first"))).drop("__n", "__cold", "__mostly", "__first"), keys)


def by_temperature(df: DataFrame, cutoff: float = 27.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    return cold_start(cold_end(df, cutoff, keys), cutoff, keys)


def large_enough(df: DataFrame, rows: int = 20, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Readings of episodes with more than `rows` rows."""
    return df.withColumn("__n", F.count(F.lit(1)).over(whole(keys))).where(F.col("__n") > rows).drop("__n")
