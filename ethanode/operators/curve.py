"""The drinking curve: threshold, rise, fall, completion, rates, area, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethanode.operators.aggregates import baseline, floored_peak
from ethanode.operators.windows import EPISODE, backwards, by, renumbered, whole


def with_episode(df: DataFrame, values: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """`df` with one row of values per episode joined to its readings."""
    return df.join(values, list(keys), "left")


def threshold_search(df: DataFrame, col: str = "tac", rows: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    """(keys, dropped, threshold): how many leading rows to drop so that the curve starts low.

    For every row, the baseline of the rows that would then come first and the range of all
    that follow are windows; the first row whose baseline lies low enough in that range is
    taken. None: the search stops at the last place it may try.
    """
    w, v = by(keys), F.col(col)
    first, rest = w.rowsBetween(0, rows), backwards(keys).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({
        "__n": F.count(F.lit(1)).over(whole(keys)),
        "__thr": F.avg(v).over(first) + F.stddev_samp(v).over(first),
        "__peak": F.max(v).over(rest),
        "__floor": F.min(v).over(rest),
        "__lead": F.max(v).over(w.rowsBetween(0, rows + 1)),
    })
    range_ = F.col("__peak") - F.col("__floor")
    ratio = (range_ - 0.5) / 7 + 1
    relative = F.col("__peak") - F.col("__thr")
    good = (F.col("__thr") < range_ / ratio + F.col("__floor")) | (range_ < 3) | ((range_ < 5) & (relative < 1))
    adjusted = F.when((F.col("__thr") < F.col("__floor")) | (F.col("__thr") > F.col("__peak")), F.col("__floor") + 0.8 * range_).when((relative < 8) & (F.col("__lead") >= F.col("__peak")), range_ / ratio + F.col("__floor")).otherwise(F.col("__thr"))
    allowed = F.col("idx") <= F.col("__n") - rows - 2
    got = d.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        F.max(F.when(F.col("idx") == 0, F.col("__peak"))).alias("peak"),
        F.max(F.when(F.col("idx") == 0, F.col("__floor"))).alias("floor"),
        F.min(F.when(allowed & good, F.struct(F.col("idx").alias("d"), adjusted.alias("t")))).alias("hit"),
        F.max("hours").alias("hours"),
    )
    flat = F.col("peak") - F.col("floor") < 2
    middle = (F.col("peak") + F.col("floor")) / 2
    stop = F.greatest(F.col("n") - rows - 1, F.lit(0))
    dropped = F.when(flat, 0).otherwise(F.coalesce("hit.d", stop))
    far = dropped / F.col("n") * F.col("hours")
    too_far = (F.col("hours") - far < 1) | (far > (F.col("hours") - far) / 3)
    restored = ~flat & (dropped > 0) & too_far
    return got.select(*keys, F.when(restored, 0).otherwise(dropped).cast("long").alias("dropped"), F.when(flat | restored | F.col("hit").isNull(), middle).otherwise(F.col("hit.t")).alias("threshold"))


def truncated(df: DataFrame, found: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Readings from the row where the search starts the curve, numbered anew, with threshold."""
    kept = with_episode(df, found, keys).where(F.col("idx") >= F.coalesce("dropped", F.lit(0)))
    return renumbered(kept.drop("dropped"), keys)


def curve_bounds(df: DataFrame, col: str = "tac", threshold: str = "curve_threshold", ramp: float = 0.005, ramp_max: float = 5.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Peak, begin and end of the curve, hours up and down, and the threshold met at its end.

    The begin is the last row before the peak, from idx 1, under the threshold, else idx 0.
    The end is the first row after the peak under a threshold that climbs by `ramp` a row up
    to `ramp_max`, else the last row. `df` carries the threshold on every row.
    """
    w, v = whole(keys), F.col(col)
    d = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__p": F.min_by("idx", F.struct(-v, F.col("idx"))).over(w)})
    up = F.when((F.col("idx") < F.col("__p")) & (F.col("idx") >= 1) & (v < F.col(threshold)), F.col("idx"))
    k = F.col("idx") - F.col("__p")
    climbing = F.col(threshold) + F.least(ramp * (k - 1), F.lit(ramp_max))
    down = F.when((k > 0) & (F.col("idx") < F.col("__n") - 1) & (v < climbing), F.col("idx"))
    row = F.struct(v.alias("v"), F.col("hours").alias("h"))
    got = d.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.max("__p").alias("peak_index"), F.coalesce(F.max(up), F.lit(0)).alias("begin"), F.coalesce(F.min(down), F.max("idx")).alias("end"),
        F.min(down).isNotNull().alias("__found"), F.max(threshold).alias("__thr"), F.max_by(row, F.struct(v, -F.col("idx"))).alias("__top"),
        F.coalesce(F.max_by(row, up), F.min_by(row, "idx")).alias("__begin"), F.coalesce(F.min_by(row, down), F.max_by(row, "idx")).alias("__end"),
    )
    steps = F.col("end") - F.col("peak_index") - F.when(F.col("__found"), 0).otherwise(1)
    return got.select(
        *keys, "n", "peak_index", "begin", "end", F.col("__thr").alias("threshold"), floored_peak(F.col("__top.v")).alias("peak"),
        (F.col("__top.h") - F.col("__begin.h")).alias("rise_duration"), (F.col("__end.h") - F.col("__top.h")).alias("fall_duration"),
        F.col("__begin.v").alias("begin_value"), F.col("__end.v").alias("end_value"),
        (F.col("__thr") + F.least(ramp * F.greatest(steps, F.lit(0)), F.lit(ramp_max))).alias("end_threshold"),
    )


def completion(value: Column, threshold: Column, relative_peak: Column) -> Column:
    over = value - threshold
    return F.when(over <= 0, 1.0).otherwise((relative_peak - over) / relative_peak)


def curve_measures(bounds: DataFrame) -> DataFrame:
    """`bounds` with completions, rates and the duration."""
    relative = F.col("peak") - F.col("threshold")
    return bounds.withColumns({
        "relative_peak": relative,
        "rise_completion": completion(F.col("begin_value"), F.col("threshold"), relative),
        "fall_completion": completion(F.col("end_value"), F.col("threshold"), relative),
        "rise_rate": F.when(F.col("rise_duration") != 0, relative / F.col("rise_duration")).otherwise(0.0),
        "fall_rate": F.when(F.col("fall_duration") != 0, relative / F.col("fall_duration")).otherwise(0.0),
        "curve_duration": F.col("rise_duration") + F.col("fall_duration"),
    })


def revised(measures: DataFrame, limit: float = 0.5, upper: float = 0.9, predicted_fall: Column | None = None, predicted_rise: Column | None = None, parity: bool = True) -> DataFrame:
    """Durations of curves that the recording cuts off.

    Under `limit` a model's prediction replaces the duration and the rate follows; under
    `upper` the duration is divided by the completion. With parity the rise is divided by the
    fall's completion; no duration where that is 0.
    """
    fall_model = predicted_fall if predicted_fall is not None else F.col("fall_duration")
    rise_model = predicted_rise if predicted_rise is not None else F.col("rise_duration")
    fc, rc = F.col("fall_completion"), F.col("rise_completion")
    out = measures.withColumns({
        "fall_duration_revised": F.when(fc < limit, fall_model).when(fc < upper, F.try_divide(F.col("fall_duration"), fc)).otherwise(F.col("fall_duration")),
        "rise_duration_revised": F.when(rc < limit, rise_model).when(rc < upper, F.try_divide(F.col("rise_duration"), fc if parity else rc)).otherwise(F.col("rise_duration")),
    })
    return out.withColumns({
        "fall_rate_revised": F.when((fc < limit) & (fall_model != 0), F.col("relative_peak") / fall_model).otherwise(F.col("fall_rate")),
        "rise_rate_revised": F.when((rc < limit) & (rise_model != 0), F.col("relative_peak") / rise_model).otherwise(F.col("rise_rate")),
    })


def curve_area(df: DataFrame, bounds: DataFrame, col: str = "tac", dx: float = 0.1, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Trapezoids from begin to end, values clipped below at the threshold, and per hour."""
    b = bounds.select(*keys, "begin", "end", F.col("threshold").alias("__thr"), "curve_duration")
    rows = with_episode(df, b, keys).where((F.col("idx") >= F.col("begin")) & (F.col("idx") <= F.when(F.col("begin") == F.col("end"), F.col("end") + 1).otherwise(F.col("end"))))
    clipped = F.greatest(F.col(col), F.col("__thr"))
    rows = rows.withColumn("__step", (clipped + F.lag(clipped).over(by(keys))) / 2)
    got = rows.groupBy(*keys).agg((F.coalesce(F.sum("__step"), F.lit(0.0)) * dx).alias("curve_auc"), F.max("curve_duration").alias("__d"))
    return got.select(*keys, "curve_auc", F.when((F.col("curve_auc") != 0) & (F.col("__d") != 0), F.col("curve_auc") / F.col("__d")).alias("curve_auc_per_hour"))


def curve_count(df: DataFrame, col: str = "tac", threshold: str = "curve_threshold", rate: float = 1.0, min_h: float = 0.5, separation_h: float = 0.1, min_peak: float = 5.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """(keys, curve_count) for every episode: runs over the threshold that are long and high enough.

    A run goes on while its rows are less than `separation_h` apart; it is counted when the
    next one starts, so the last is not. Its duration is its span of rows, one more for the
    first run, and the peak is over the rows from its first (one earlier for the first run) to
    the next run's first.
    """
    w, v = by(keys), F.col(col)
    over = F.when(v > F.col(threshold), F.col("idx"))
    d = df.select(*keys, "idx", v.alias("__v"), over.alias("__over"), F.last(over, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__last"))
    starts = F.col("__over").isNotNull() & F.coalesce((F.col("__over") - F.col("__last")) * rate / 60 >= separation_h, F.lit(True))
    d = d.withColumn("run", F.sum(starts.cast("int")).over(w))  # 0 before the first run
    runs = d.groupBy(*keys, "run").agg(F.min("idx").alias("lo"), F.max("__over").alias("hi"), F.max("__v").alias("top"), F.min_by("__v", "idx").alias("opens"), F.max_by("__v", "idx").alias("closes"))
    w = by(keys, "run")
    first = F.col("run") == 1
    # a run reaches to the next one's first row, and the first one begins a row early
    peak = F.greatest("top", F.lead("opens").over(w), F.when(first, F.lag("closes").over(w)))
    runs = runs.withColumns({"peak": peak, "next": F.lead("lo").over(w), "duration": (F.col("hi") - F.col("lo") + first.cast("int")) * rate / 60})
    counted = (F.col("run") > 0) & F.col("next").isNotNull() & (F.col("duration") >= min_h) & (F.col("peak") > min_peak)
    return runs.groupBy(*keys).agg(F.count(F.when(counted, 1)).alias("curve_count"))


def thresholded(df: DataFrame, col: str = "tac", rows: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Readings with the plain threshold: baseline mean plus one standard deviation."""
    return with_episode(df, baseline(df, col, rows, keys).select(*keys, "curve_threshold"), keys)
