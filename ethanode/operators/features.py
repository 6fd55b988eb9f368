"""The feature row of an episode, from the raw and from the cleaned signal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.config import EngineConfig
from ethanode.operators import aggregates, curve, learning

#: Features that fall back to the raw signal's where the cleaned one has none.
FALLBACK = ("auc_total", "auc_per_hour", "curve_auc", "curve_auc_per_hour", "avg_tac_diff")


def signal_features(df: DataFrame, col: str, suffix: str, keys: Sequence[str], config: EngineConfig = EngineConfig(), threshold: str | None = None) -> DataFrame:
    """One row per episode for the signal `col`, its columns ending in the suffix."""
    df = df.withColumn("tac", F.col(col))
    if threshold is None:
        df = curve.thresholded(df, "tac", config.baseline_range, keys)
        threshold = "curve_threshold"
    df = df.withColumn(threshold, F.coalesce(threshold, F.lit(0.0)))
    bounds = curve.curve_bounds(df, "tac", threshold, config.fall_ramp_step, config.fall_ramp_max, keys)
    measures = curve.curve_measures(bounds).drop("n")
    parts = [
        aggregates.signal_totals(df, "tac", config.baseline_range, config.auc_dx, keys).drop("curve_threshold"), curve.curve_area(df, measures, "tac", config.auc_dx, keys),
        curve.curve_count(df, "tac", threshold, config.sampling_rate, config.curve_min_h, config.curve_separation_h, config.curve_min_peak, keys),
    ]
    out = measures
    for p in parts:  # all share the episode partitioning
        out = out.join(p, list(keys), "left")
    return out.withColumnsRenamed({c: f"{c}_{suffix}" for c in out.columns if c not in keys})


def episode_features(df: DataFrame, raw: str, clean: str, keys: Sequence[str], config: EngineConfig = EngineConfig(), threshold: str | None = None) -> DataFrame:
    """Raw and clean features side by side; falsy clean areas and steps fall back to raw."""
    both = signal_features(df, raw, "raw", keys, config).join(signal_features(df, clean, "cln", keys, config, threshold), list(keys))
    return both.withColumns({f"{c}_cln": F.when(F.coalesce(F.col(f"{c}_cln"), F.lit(0.0)) != 0, F.col(f"{c}_cln")).otherwise(F.col(f"{c}_raw")) for c in FALLBACK})


def revised_features(features: DataFrame, models: Mapping[str, PipelineModel], config: EngineConfig = EngineConfig(), suffix: str = "") -> DataFrame:
    """`features` with the durations and rates of cut-off curves revised, in columns ending in `_revised`.

    `models` has fall_duration and rise_duration (`learning.feature_estimators`); where one is
    missing, or a predictor has no value, the measured duration stays.
    """
    wanted = ("fall_duration", "rise_duration")
    out = learning.estimated(features, {k: models[k] for k in wanted if k in models})
    named = ("fall_completion", "rise_completion", "relative_peak", "fall_rate", "rise_rate", *wanted)
    plain = out.select(*features.columns, *[F.col(f"{c}{suffix}").alias(f"__{c}") for c in named], *[F.coalesce(F.col(f"predicted_{k}") if k in models else F.lit(None), F.col(f"{k}{suffix}")).alias(f"__predicted_{k}") for k in wanted])
    hidden = plain.select(F.struct(*features.columns).alias("__all"), *[F.col(f"__{c}").alias(c) for c in named], *[F.col(f"__predicted_{k}").alias(f"predicted_{k}") for k in wanted])
    found = curve.revised(hidden, config.revision_limit, config.revision_upper, F.col("predicted_fall_duration"), F.col("predicted_rise_duration"))
    return found.select("__all.*", *[F.col(f"{c}_revised").alias(f"{c}{suffix}_revised") for c in (*wanted, "fall_rate", "rise_rate")])


def valid_and_invalid(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) episodes; those without a verdict are invalid."""
    return features.where("valid = 1"), features.where("coalesce(valid, 0) <> 1")


def cleaning_stage(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """cleaning_stage: the first stage whose value differs from all before it and equals all after it, else null."""
    found = None
    for i, s in enumerate(stages[1:], 1):
        differs, same = F.lit(True), F.lit(True)
        for earlier in stages[:i]:
            differs = differs & ~F.col(s).eqNullSafe(F.col(earlier))
        for later in stages[i + 1 :]:
            same = same & F.col(s).eqNullSafe(F.col(later))
        found = F.when(differs & same, F.lit(s)) if found is None else found.when(differs & same, F.lit(s))
    return df.withColumn("cleaning_stage", found)
