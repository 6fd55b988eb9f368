"""What the plots show, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.operators.windows import EPISODE


def column_series(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = EPISODE) -> DataFrame:
    """(keys, hours, series, value): curves of several columns laid over each other."""
    return df.select(*keys, "hours", *[F.col(c).cast("double") for c in cols]).unpivot([*keys, "hours"], list(cols), "series", "value")


def cropping(before: DataFrame, after: DataFrame, row: str = "event_id") -> DataFrame:
    """`before` with kept: whether the crop left the row."""
    return before.join(after.select(row).withColumn("__kept", F.lit(1)), row, "left").withColumn("kept", F.coalesce("__kept", F.lit(0))).drop("__kept")


def device_removal(df: DataFrame, cutoff: float = 27.0, prediction: str | None = None) -> DataFrame:
    """`df` with side: `on` or `off`, by a prediction column or the temperature; null without either."""
    on = F.col(prediction) == 1 if prediction else F.col("temp") > cutoff
    return df.withColumn("side", F.when(on, "on").when(~on, "off"))


def event_lines(nearest: DataFrame, df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Events with the hour and value of the reading nearest to them."""
    return nearest.join(df.select(*keys, "idx", "hours", "tac"), [*keys, "idx"])
