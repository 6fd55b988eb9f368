"""Writers of processed readings, features and reports, as folders of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethanode.operators.learning import area_under_roc


def present(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns of `order` that `df` has, then its others."""
    first = [c for c in order if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def rounded(df: DataFrame, after: int = 15, places: int = 2, keep: str = "_N") -> DataFrame:
    """Numeric columns from position `after` on rounded, but for those whose names end in `keep`."""
    names = [f.name for i, f in enumerate(df.schema.fields) if i >= after and isinstance(f.dataType, (T.DoubleType, T.FloatType)) and not f.name.endswith(keep)]
    return df.withColumns({c: F.round(c, places) for c in names}) if names else df


def long_features(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value): an episode's summary blocks as rows."""
    numbers = [f.name for f in features.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    return features.select(*keys, *[F.col(c).cast("double") for c in numbers]).unpivot(list(keys), numbers, "feature", "value")


def write_episodes(readings: DataFrame, raw: DataFrame, features: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Data, unprocessed data and features, each parted by episode."""
    for name, df in (("data", readings), ("unprocessed", raw), ("features", features)):
        df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}")


def write_report(path: str, **tables: DataFrame) -> None:
    """One folder of Parquet files per table of a cohort's report."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def split_manifest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def write_split(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Day slices, one folder each, and the manifest of their ids and times."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/slices")
    split_manifest(df, keys).write.mode("overwrite").parquet(f"{path}/split_details")


def metadata_template(metadata: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metadata with use_data N for the excluded episodes."""
    out = metadata.join(excluded.select(*keys).distinct().withColumn("__out", F.lit(True)), list(keys), "left")
    return out.withColumn("use_data", F.when(F.col("__out"), "N").otherwise(F.col("use_data"))).drop("__out")


def model_performance(confusion: DataFrame, scored: DataFrame | None = None, probability: str = "probability", truth: str = "truth") -> DataFrame:
    """The confusion figures with accuracy, sensitivity and specificity rounded to two places, and the area under the ROC curve of `scored`."""
    out = confusion.withColumns({c: F.round(c, 2) for c in ("accuracy", "sensitivity", "specificity")})
    if scored is None:
        return out
    area = area_under_roc(scored, probability, truth).select(F.round("auc", 4).alias("auc"), F.lit(1).alias("__one"))
    return out.withColumn("__one", F.lit(1)).join(area, "__one", "left").drop("__one")


def model_probabilities(scored: DataFrame, identifier: Column, probability: str = "probability") -> DataFrame:
    """(ID, negative, positive): both probabilities of each predicted row, rounded to two places."""
    p = F.col(probability)
    return scored.where(p.isNotNull()).select(identifier.alias("ID"), F.round(1 - p, 2).alias("negative"), F.round(p, 2).alias("positive"))
