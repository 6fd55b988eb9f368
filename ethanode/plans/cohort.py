"""A cohort from readings to features: chained transformations over episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.config import EngineConfig
from ethanode.functions import identifiers as ids
from ethanode.operators import aggregates, cleaning, crop, curve, features, joins, smoothing, windows
from ethanode.scratch import materialize


def cleaned(df: DataFrame, keys: Sequence[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """The cleaning stages in order; tac_* columns keep the value after each stage."""
    df = df.withColumn("tac_raw", F.col("tac"))
    df = cleaning.sloped_start(df, keys).withColumn("tac_sloped_start", F.col("tac"))
    df = cleaning.negatives_to_zero(df, config.parity).withColumn("tac_negatives", F.col("tac"))
    df = cleaning.insert_gap_rows(df, config.gap_fill_h, config.sampling_rate, keys=keys)
    return cleaning.repaired(df, config.extreme_tac, config.wear_temp_c, config.major_threshold, config.minor_threshold, keys)


def processed(df: DataFrame, keys: Sequence[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Readings cropped, cleaned, smoothed and cut to where the curve starts, with threshold.

    The cleaned readings are written before they are smoothed, and the smoothed ones before the
    threshold is searched in them, so that no episode goes through Python or is smoothed twice.
    """
    df = crop.max_duration(df, config.max_duration_h, keys)
    if config.crop_by_temperature:
        df = crop.by_temperature(df, config.wear_temp_c, keys)
    df = materialize(cleaned(crop.large_enough(df, config.min_rows, keys), keys, config), "cleaned")
    df = smoothing.smoothed(df, "tac_processed", "tac_smooth", config.smoothing_window, config.smoothing_order, keys)
    df = materialize(smoothing.lifted(df, "tac_smooth", keys), "smoothed")
    return curve.truncated(df, curve.threshold_search(df, "tac_smooth", config.baseline_range, keys), keys)


def cohort_features(df: DataFrame, keys: Sequence[str], config: EngineConfig = EngineConfig(), estimators: Mapping[str, PipelineModel] | None = None) -> DataFrame:
    """Feature rows with quality verdicts, for the output of `processed`.

    Durations and rates of cut-off curves are revised, by `estimators` (`learning.feature_estimators`
    of an earlier cohort's rows) where they are given.

    The readings are written once and read by every aggregate: the cleaning stages run Python
    per episode and should not run again for each.
    """
    df = materialize(df, "readings")
    rows = features.episode_features(df, "tac_raw", "tac_smooth", keys, config, threshold="threshold")
    rows = features.revised_features(rows, estimators or {}, config, "_cln")
    checks = aggregates.quality_control(df, config.min_active_h, config.max_inactive_pct, config.max_imputed_pct, keys)
    return rows.join(checks, list(keys), "left")


def initial_validity(df: DataFrame, metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reason): why an episode is not processed: not to be used, several devices; null where it is."""
    devices = df.groupBy(*keys).agg((F.count_distinct("device_id") + F.max(F.col("device_id").isNull().cast("int"))).alias("__d"))
    used = metadata.groupBy(*keys).agg(F.max(F.coalesce(F.col("use_data") == "Y", F.lit(False)).cast("int")).alias("__use"))
    return devices.join(used, list(keys), "left").select(*keys, F.when(F.coalesce("__use", F.lit(0)) == 0, "excluded by metadata").when(F.col("__d") > 1, "multiple devices").alias("reason"))


def cropped_away(wanted: DataFrame, cropped: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """(keys, invalid_reason, valid) of the wanted episodes of which fewer than `least` rows are left after cropping."""
    left = cropped.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    gone = wanted.select(*keys).distinct().join(left, list(keys), "left").where(F.coalesce("__n", F.lit(0)) < least)
    return gone.select(*keys, F.lit("no data within crop times").alias("invalid_reason"), F.lit(0).alias("valid"))


def run(readings: DataFrame, metadata: DataFrame, config: EngineConfig = EngineConfig(), upload_zone: str | None = None, estimators: Mapping[str, PipelineModel] | None = None) -> tuple[DataFrame, DataFrame]:
    """(processed readings, features with metadata) of a cohort whose readings carry subid and dataset.

    Recordings with more than one row a minute are thinned first. Readings uploaded in
    `upload_zone` move to their episode's own time zone before the study times crop them;
    without one, or with 999, they stay. Episodes of which the crop leaves fewer than
    `min_rows_after_crop` rows come out as invalid, without features.
    """
    keys = ("subid", "dataset_identifier", "episode_identifier")
    readings = readings.withColumn("event_id", F.xxhash64("ts", "tac", "temp", "motion"))
    readings = cleaning.thinned_where_dense(readings, config.downsample_s, keys[:2])
    fanned = joins.fan_out(readings, metadata)
    zone = metadata if "time_zone" in metadata.columns else metadata.withColumn("time_zone", F.lit(None).cast("string"))
    for c in ("crop_begin_date", "crop_begin_time", "crop_end_date", "crop_end_time"):
        zone = zone if c in zone.columns else zone.withColumn(c, F.lit(None).cast("string"))
    if upload_zone is not None:
        own = zone.select(*keys, F.col("time_zone").alias("__zone"), F.col("crop_begin_date").cast("string").alias("__date"))
        fanned = crop.shifted_to_zone(joins.with_metadata(fanned, own, keys), upload_zone, "__zone", "__date").drop("__zone", "__date")
    first = fanned.groupBy(*keys).agg(F.min("ts").alias("min_ts"))
    bounds = crop.session_bounds(zone, first, keys, config.crop_begin_adjust_h, config.crop_end_adjust_h, config.max_duration_h)
    good = initial_validity(fanned, metadata, keys).where("reason is null")
    cropped = materialize(crop.between(windows.numbered(joins.semi(fanned, good, keys), keys), bounds, keys), "cropped")
    out = processed(cropped, keys, config)
    rows = cohort_features(out, keys, config, estimators)
    rows = rows.unionByName(cropped_away(good, cropped, keys, config.min_rows_after_crop), allowMissingColumns=True)
    about = metadata.withColumns({"binge": ids.binge(F.col("total_drinks"), F.col("sex")) if "sex" in metadata.columns else F.lit("Unk"), "condition": ids.coerced_condition(F.col("condition"))})
    return out, joins.with_metadata(rows, about, keys)
