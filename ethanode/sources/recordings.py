"""Recordings, metadata and events, as readings and rows; and the driver's tables as such."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethanode.functions import identifiers as ids
from ethanode.functions.dates import recorded_time, standard_dates
from ethanode.operators.joins import event_rows, stacked
from ethanode.operators.windows import numbered
from ethanode.schema import KEYS, METADATA, nan_to_null, normalize_columns
from ethanode.sources import workbooks


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV where the path ends so (no types are guessed), the first sheet of a workbook, as texts, else Parquet."""
    if path.rstrip("/").endswith("csv"):
        return spark.read.csv(path, header=True)
    if path.endswith(".xlsx"):
        return workbooks.read_sheet(spark, path)
    return spark.read.parquet(path)


def readings_of(df: DataFrame, file_name: str | None = None) -> DataFrame:
    """Canonical readings of a raw export: subid and dataset from the file's name where given."""
    df = normalize_columns(df)
    for c in ("device_id", "Firmware Version", "Temperature_C", "Motion"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    used = ("datetime", "TAC", "Temperature_C", "Motion", "Firmware Version", "device_id")
    others = [c for c in df.columns if c not in used]
    out = df.select(
        *[F.col(f"`{c}`") for c in others], recorded_time(F.col("datetime")).alias("ts"), F.expr("try_cast(TAC AS double)").alias("tac"), F.expr("try_cast(Temperature_C AS double)").alias("temp"),
        F.expr("try_cast(Motion AS double)").alias("motion"), F.col("Firmware Version").cast("string").alias("firmware_version"), F.col("device_id").cast("string").alias("device_id"),
    )
    if file_name is not None:
        name = F.col(file_name)
        out = out.withColumns({"subid": ids.subid_of(name), "dataset_identifier": ids.dataset_of(name)})
    return nan_to_null(out)


def read_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """All recordings of a folder of CSV files and workbooks; subid and dataset come from the files' names.

    Files whose names do not follow the convention, such as metadata beside the recordings, are left out.
    """
    parts = []
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    kinds = {r[0] for r in files.select(ids.extension_of(F.col("name"))).distinct().collect()}
    if "csv" in kinds:
        parts.append(spark.read.csv(folder, header=True, pathGlobFilter="*.csv").select("*", F.col("_metadata.file_name").alias("__file")))
    if "xlsx" in kinds:
        found = workbooks.workbook_files(spark, folder).where(ids.follows_convention(F.element_at(F.split("path", "/"), -1)))
        parts.append(workbooks.sheet_table(found, path_col="__path").withColumn("__file", F.url_decode(F.element_at(F.split("__path", "/"), -1))).drop("__path"))
    if not parts:
        raise FileNotFoundError(f"no recordings in {folder}")
    read = [readings_of(p.where(ids.follows_convention(F.col("__file"))), "__file").withColumnRenamed("__file", "file_name") for p in parts]
    return stacked(*read)


#: Columns of a study's metadata and their canonical names.
METADATA_NAMES = {
    "SubID": "subid", "Dataset_Identifier": "dataset_identifier", "Episode_Identifier": "episode_identifier", "Use_Data": "use_data", "Condition": "condition",
    "TotalDrks": "total_drinks", "Sex": "sex", "AUD": "aud", "Notes": "notes", "Crop Begin Date": "crop_begin_date", "Crop Begin Time": "crop_begin_time",
    "Crop End Date": "crop_end_date", "Crop End Time": "crop_end_time", "Time Zone": "time_zone",
}


def metadata_of(raw: DataFrame) -> DataFrame:
    """Canonical metadata of a sheet or table of texts: padded datasets, labelled episodes, dates by one decision a column; other columns stay, missing ones are null.

    Rows without a subject are left out.
    """
    df = raw.withColumnsRenamed({k: v for k, v in METADATA_NAMES.items() if k in raw.columns})
    for f in METADATA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast("string"))
    whole = {c: F.regexp_replace(F.col(c).cast("string"), r"\.0+$", "") for c in ("subid", "dataset_identifier", "episode_identifier", "sex", "aud")}
    df = df.withColumns(whole).where(F.coalesce("subid", F.lit("")) != "")
    df = df.withColumns({
        "dataset_identifier": ids.padded_dataset(F.col("dataset_identifier")), "episode_identifier": ids.episode_label(F.col("episode_identifier")),
        "total_drinks": F.expr("try_cast(total_drinks AS double)"), "sex": F.expr("try_cast(sex AS int)"), "aud": F.expr("try_cast(aud AS int)"),
        "crop_begin_date": F.substring_index(F.col("crop_begin_date").cast("string"), " ", 1), "crop_end_date": F.substring_index(F.col("crop_end_date").cast("string"), " ", 1),
    })
    for c in ("crop_begin_date", "crop_end_date"):
        df = standard_dates(df, c).withColumn(c, F.col(c).cast("string"))
    return df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata_of(read_table(spark, path))


def read_event_times(spark: SparkSession, path: str, sheet: str = "Additional_Timestamps") -> DataFrame:
    """(keys, event_name, event_ts) of a metadata workbook's sheet of times; no rows where it has none."""
    table = workbooks.read_sheet(spark, path, sheet)
    keyed = table.withColumnsRenamed({k: v for k, v in METADATA_NAMES.items() if k in table.columns})
    if not set(KEYS) <= set(keyed.columns):
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in KEYS) + ", event_name string, event_ts timestamp")
    return event_times(keyed.withColumns({"dataset_identifier": ids.padded_dataset(F.col("dataset_identifier")), "episode_identifier": ids.episode_label(F.col("episode_identifier"))}), KEYS)


def cohort_metadata(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Metadata made up from file names: one episode for each dataset, to be used."""
    c = F.col(name)
    return files.select(name).distinct().where(ids.follows_convention(c)).select(
        ids.subid_of(c).alias("subid"), ids.dataset_of(c).alias("dataset_identifier"), F.lit("e1").alias("episode_identifier"),
        F.lit("Y").alias("use_data"), ids.condition_in_name(c).alias("condition"), F.lit(None).cast("double").alias("total_drinks"),
    )


def used_datasets(files: DataFrame, name: str = "file_name") -> DataFrame:
    c = F.col(name)
    return files.select(ids.subid_of(c).alias("subid"), ids.dataset_of(c).alias("ds")).where("ds is not null").groupBy("subid").agg(F.array_sort(F.collect_set("ds")).alias("datasets"))


def free_dataset(used: DataFrame) -> DataFrame:
    """(subid, dataset): the smallest positive number, padded, that a subject has not used."""
    taken = F.transform("datasets", lambda d: d.cast("int"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("datasets") + 1), taken))
    return used.select("subid", ids.padded_dataset(free).alias("dataset"))


def metadata_problems(metadata: DataFrame, files: DataFrame, required: Sequence[str] = ("subid", "dataset_identifier", "episode_identifier", "use_data", "condition", "total_drinks")) -> DataFrame:
    """(problem, detail): missing columns, files without metadata, episodes given twice."""
    spark = metadata.sparkSession
    out = spark.createDataFrame([("missing column", c) for c in required if c not in metadata.columns], "problem string, detail string")
    keys = ["subid", "dataset_identifier"]
    if all(k in metadata.columns for k in keys):
        lost = files.select(*keys).distinct().join(metadata.select(*keys).distinct(), keys, "left_anti")
        out = out.unionByName(lost.select(F.lit("no metadata").alias("problem"), F.concat_ws("_", *keys).alias("detail")))
    if all(k in metadata.columns for k in [*keys, "episode_identifier"]):
        twice = metadata.groupBy(*keys, "episode_identifier").count().where("count > 1")
        out = out.unionByName(twice.select(F.lit("given twice").alias("problem"), F.concat_ws("_", *keys, "episode_identifier").alias("detail")))
    return out


def processor_ready(features: DataFrame, least: int = 2) -> bool:
    """Whether a table of features has enough episodes, and no label that is not Alc, Non or Unk."""
    got = features.agg(F.count(F.lit(1)).alias("n"), F.sum((~F.coalesce(F.col("condition").isin("Alc", "Non", "Unk"), F.lit(False))).cast("long")).alias("bad")).first()
    return got["n"] >= least and not got["bad"]


def event_times(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events of a sheet of times: every column past the sixth is one."""
    return event_rows(df, keys, df.columns[6:])


# --- the driver's tables -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """Events as readings, numbered; an episode is a user's month (a month ends at 6:00 of the next one's first day), so episodes grow in number with users and time."""
    k = F.get_json_object("props", "$.k").cast("int")
    df = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - F.lit(shift)).alias("tac"),
        (k / 100).alias("motion"), (22 + F.pmod(k, F.lit(16))).cast("double").alias("temp"),
    )
    month = F.date_format(F.col("ts") - F.expr("INTERVAL 6 HOURS"), "yyyy-MM")
    return numbered(df.withColumn("episode", F.concat_ws("_", "user_id", month)))


def customer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as study metadata: one episode each."""
    c = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("user_id"), (1 + F.pmod("c_nationkey", F.lit(2))).cast("int").alias("sex"), F.floor(F.pmod(F.abs("c_acctbal"), F.lit(8.0))).cast("double").alias("drinks"),
        F.when(segment == "BUILDING", "Alc").when(segment == "MACHINERY", "Non").otherwise("Unk").alias("condition"), F.when(F.col("c_nationkey") == 3, "N").otherwise("Y").alias("use_data"),
    )


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first `error` (device off) and `signup` (device on) of each episode."""
    df = event_readings(spark, sf_dir).where("event_type in ('error', 'signup')")
    name = F.when(F.col("event_type") == "error", "off").otherwise("on")
    return df.groupBy("episode", name.alias("event_name")).agg(F.min("ts").alias("event_ts"))
