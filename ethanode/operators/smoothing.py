"""Savitzky-Golay smoothing with mirrored ends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethanode.operators.windows import EPISODE, by, whole


def coefficients(window: int = 51, order: int = 3) -> list[float]:
    """Weights of the centre value of a least-squares polynomial over an odd window."""
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1) / max(half, 1), order + 1, increasing=True)
    return [float(x) for x in np.linalg.pinv(powers)[0]]


def smoothed(df: DataFrame, col: str = "tac", out: str = "smooth", window: int = 51, order: int = 3, keys: Sequence[str] = EPISODE) -> DataFrame:
    """`df` with `out`, the filtered `col`; past an end the series is mirrored about its last value, again and again if it is short."""
    half = window // 2
    n, i = F.col("__n"), F.col("idx").cast("int")
    period = F.greatest(2 * (n - 1), F.lit(1))
    # where a row stands: at its own place, and, near an end, at its mirrored ones beyond it
    turns = F.sequence(-F.floor(half / period).cast("int") - 1, F.floor(half / period).cast("int") + 2)
    places = F.array_distinct(F.flatten(F.transform(turns, lambda k: F.array(i + k * period, k * period - i))))
    beyond = F.filter(places, lambda p: (p >= -half) & (p <= n - 1 + half))
    # functions over arrays are interpreted for every row: a series longer than half a window has at most two mirrored places, written out
    head, tail = (i > 0) & (i <= half), (i < n - 1) & (i >= n - 1 - half)
    plain = F.when(head & tail, F.array(i, -i, period - i)).when(head, F.array(i, -i)).when(tail, F.array(i, period - i)).otherwise(F.array(i))
    d = df.withColumn("__n", F.count(F.lit(1)).over(whole(keys)).cast("int"))
    d = d.withColumn("__at", F.explode(F.when(n - 1 <= half, beyond).otherwise(plain)))
    frame = by(keys, "__at").rowsBetween(-half, half)
    d = d.withColumn("__ys", F.collect_list(F.coalesce(col, F.lit(0.0))).over(frame))
    # the sum is written out: functions over arrays are interpreted for every row
    total = reduce(Column.__add__, [F.get("__ys", F.lit(k)) * c for k, c in enumerate(coefficients(window, order))], F.lit(0.0))
    return d.where(F.col("__at") == F.col("idx")).withColumn(out, total).drop("__n", "__at", "__ys")


def lifted(df: DataFrame, col: str = "smooth", keys: Sequence[str] = EPISODE) -> DataFrame:
    """The whole series moved up where its minimum is negative."""
    return df.withColumn(col, F.col(col) - F.least(F.min(col).over(whole(keys)), F.lit(0.0)))
