"""Schemas of the engine's tables and the names under which raw files carry their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers of device exports and the canonical names.
ALIASES = {
    "device timestamp": "datetime", "Timestamp": "datetime",
    "Device Serial Number": "device_id", "device id": "device_id", "device.id": "device_id",
    "firmware version": "Firmware Version", "Firmware version": "Firmware Version",
    "tac (ug/L)": "TAC", "TAC ug/L(air)": "TAC",
    "temperature (C)": "Temperature_C", "Temperature (C)": "Temperature_C", "Temperature C": "Temperature_C", "Temperature LSB": "Temperature_C",
    "motion (g)": "Motion", "Motion LSB": "Motion",
}
JUNK = ("TAC LSB", "level_0")

KEYS = ("subid", "dataset_identifier", "episode_identifier")

READINGS = T.StructType([
    T.StructField("subid", T.StringType()), T.StructField("dataset_identifier", T.StringType()), T.StructField("episode_identifier", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("device_id", T.StringType()), T.StructField("firmware_version", T.StringType()),
    T.StructField("tac", T.DoubleType()), T.StructField("temp", T.DoubleType()), T.StructField("motion", T.DoubleType()),
])

METADATA = T.StructType([
    T.StructField("subid", T.StringType()), T.StructField("dataset_identifier", T.StringType()), T.StructField("episode_identifier", T.StringType()),
    T.StructField("use_data", T.StringType()), T.StructField("condition", T.StringType()), T.StructField("total_drinks", T.DoubleType()),
    T.StructField("sex", T.IntegerType()), T.StructField("aud", T.IntegerType()), T.StructField("notes", T.StringType()),
    T.StructField("crop_begin_date", T.StringType()), T.StructField("crop_begin_time", T.StringType()),
    T.StructField("crop_end_date", T.StringType()), T.StructField("crop_end_time", T.StringType()), T.StructField("time_zone", T.StringType()),
])


def normalize_columns(df: DataFrame) -> DataFrame:
    """Canonical names for known headers; junk columns go, unknown ones stay."""
    renamed = {k: v for k, v in ALIASES.items() if k in df.columns and v not in df.columns}
    return df.withColumnsRenamed(renamed).drop(*JUNK)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, and only null is skipped by Spark's aggregates."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
