"""Extensions: readings that arrive as a stream, by day and by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.operators.aggregates import floored_peak


def day_summaries(stream: DataFrame, split_h: int = 6, late: str = "1 hour") -> DataFrame:
    """Count, mean and peak per device and day from split_h, as windows of a stream of (device_id, ts, tac)."""
    w = F.window("ts", "24 hours", startTime=f"{split_h} hours")
    return stream.withWatermark("ts", late).groupBy("device_id", w).agg(F.count(F.lit(1)).alias("n"), F.avg("tac").alias("mean"), floored_peak(F.max("tac")).alias("peak"))


def wear_sessions(stream: DataFrame, pause: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of readings without a pause, per device."""
    return stream.withWatermark("ts", late).groupBy("device_id", F.session_window("ts", pause)).agg(F.count(F.lit(1)).alias("n"), F.max("tac").alias("peak"))
