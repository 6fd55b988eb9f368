"""Joins and set operations between readings, metadata, events and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethanode.operators.windows import EPISODE

#: Rows under which a looked-up table is broadcast; more go through a shuffle.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if it is proven small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_metadata(df: DataFrame, metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of `df` with the first metadata row of its keys, or nulls."""
    others = [c for c in metadata.columns if c not in keys]
    first = metadata.groupBy(*keys).agg(*[F.first(c).alias(c) for c in others])
    return df.join(sized(first), list(keys), "left")


def fan_out(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """A dataset's readings once for each of its episodes to use."""
    wanted = metadata.where("use_data = 'Y'").select("subid", "dataset_identifier", "episode_identifier").distinct()
    return files.drop("episode_identifier").join(sized(wanted), ["subid", "dataset_identifier"])


def merged(df: DataFrame, extra: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of chosen extra columns on a key of the same name."""
    return df.join(extra.select(key, *columns), key, "left")


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all common columns, null matching null."""
    common = [c for c in left.columns if c in right.columns]
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in common})
    same = F.lit(True)
    for c in common:
        same = same & left[c].eqNullSafe(renamed[f"__r_{c}"])
    return left.join(renamed, same).drop(*[f"__r_{c}" for c in common])


def outer_by_row(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Full outer join on a key; of columns on both sides the left one stays."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key, "outer")


def nearest_reading(df: DataFrame, events: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """(keys, event_name, event_ts, idx): the reading nearest in time to each event, the first on ties.

    Readings and events are sorted together: the last reading up to an event and the first one
    after it are what running windows in both directions hold, and the nearer of them is taken.
    Events without a time, and those of episodes without readings, have none and are left out.
    """
    reading = F.struct("ts", "idx")
    rows = df.where("ts is not null").select(*keys, "ts", "idx", F.lit(None).cast("string").alias("event_name"), reading.alias("__r"))
    marks = events.where("event_ts is not null").select(*keys, F.col("event_ts").cast(df.schema["ts"].dataType).alias("ts"), F.lit(None).cast(df.schema["idx"].dataType).alias("idx"), "event_name", F.lit(True).alias("__event"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    later = F.col("__event").isNotNull().cast("int")  # of one moment, readings come before events, and the first reading last
    upward = Window.partitionBy(*keys).orderBy("ts", later, F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    downward = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), later.desc(), F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sides = [F.last("__r", ignorenulls=True).over(w) for w in (upward, downward)]
    found = both.withColumns({"__before": sides[0], "__after": sides[1]}).where("__event")
    away = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.unix_micros("ts") - F.unix_micros(F.col(c)["ts"])).alias("d"), F.col(c)["idx"].alias("idx"))) for c in ("__before", "__after")]
    out = found.select(*keys, "event_name", F.col("ts").alias("event_ts"), F.least(*away)["idx"].alias("idx")).where("idx is not null")
    return out.dropDuplicates([*keys, "event_name", "event_ts"])


def event_rows(df: DataFrame, keys: Sequence[str], event_columns: Sequence[str]) -> DataFrame:
    """Columns of event times as rows (keys, event_name, event_ts); what does not parse goes."""
    long = df.unpivot(list(keys), list(event_columns), "event_name", "event_text")
    ts = F.coalesce(F.try_to_timestamp("event_text", F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp("event_text", F.lit("yyyy-MM-dd HH:mm:ss")))
    return long.select(*keys, "event_name", ts.alias("event_ts")).where("event_ts is not null")


def labelled_by_events(df: DataFrame, events: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """device_on_label: 0 from an event whose name holds `off`, 1 from one that holds `on`, null before the first; at one moment, off events count last."""
    sides = F.when(F.lower("event_name").contains("off"), 0).when(F.lower("event_name").contains("on"), 1)
    marks = events.select(*keys, F.col("event_ts").alias("ts"), sides.alias("__label")).where("__label is not null")
    both = df.withColumn("__label", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ts", F.col("idx").asc_nulls_first(), F.col("__label").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("device_on_label", F.last("__label", ignorenulls=True).over(w)).where("idx is not null").drop("__label")


def excluded_and_kept(df: DataFrame, filters: dict[str, Sequence]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded), both distinct: rows with a listed value in any filtered column are excluded."""
    hit: Column = F.lit(False)
    for c, values in filters.items():
        hit = hit | F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    return df.where(~hit).dropDuplicates(), df.where(hit).dropDuplicates()


def anti(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def semi(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def written_back(features: DataFrame, predictions: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return features.join(predictions.select(*keys, *columns), list(keys), "left")


def cross_validation_marks(features: DataFrame, results: DataFrame, keys: Sequence[str] = ("subid", "truth", "condition")) -> DataFrame:
    """cv_result: `incorrect` where any result of the keys is, else `correct` where one is, else null."""
    got = results.groupBy(*keys).agg(F.max((F.col("result") == "incorrect").cast("int")).alias("__bad"))
    return features.join(got, list(keys), "left").withColumn("cv_result", F.when(F.col("__bad") == 1, "incorrect").when(F.col("__bad") == 0, "correct")).drop("__bad")


def stacked(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
