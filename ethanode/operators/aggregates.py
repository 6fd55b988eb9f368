"""Per-episode aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethanode.operators.windows import EPISODE, by, whole


def _spread(col: str) -> list[Column]:
    sd = F.stddev_samp(col)
    return [F.avg(col).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(col))).alias("sem")]


def mean_sd_sem(df: DataFrame, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    return df.groupBy(*keys).agg(*_spread(col))


def floored_peak(peak: Column) -> Column:
    """A peak of at most 0.5, or none, counts as 1."""
    return F.when(peak > 0.5, peak).otherwise(1.0)


def first_peak_index(col: str = "tac") -> Column:
    return F.min_by("idx", F.struct(-F.col(col), F.col("idx")))


def episode_summary(df: DataFrame, keys: Sequence[str] = EPISODE, dx: float = 0.1) -> DataFrame:
    """Rows, mean, spread, peak with its place, and area of each episode: one shuffle for all."""
    w = by(keys)
    rows = df.withColumn("__step", (F.col("tac") + F.lag("tac").over(w)) / 2)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("tac").alias("mean"), F.stddev_samp("tac").alias("sd"),
        (F.stddev_samp("tac") / F.sqrt(F.count("tac"))).alias("sem"), floored_peak(F.max("tac")).alias("peak"),
        first_peak_index().alias("peak_index"), (F.sum("__step") * dx).alias("auc_total"), F.max("hours").alias("hours"),
    )


def windowed_peak(df: DataFrame, width: int, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    """`df` with local_peak: the floored maximum from `width` rows before to `width` after.

    Near an episode's end the published tool reaches n - width - 1 rows ahead instead of to
    the last row, and near its start back to row 1; both are kept.
    """
    n, w, i = F.count(F.lit(1)).over(whole(keys)), by(keys), F.col("idx")
    d = df.withColumns({"__n": n, "__v": F.when(i > 0, F.col(col))})
    # maxima over 1, 2, 4 ... rows up to this one and from it on, each from two of the half width
    d, step = d.withColumns({"__b": F.col("__v"), "__f": F.col("__v")}), 1
    while 2 * step <= width + 1:
        d = d.withColumns({"__b": F.greatest("__b", F.lag("__b", step).over(w)), "__f": F.greatest("__f", F.lead("__f", step).over(w))})
        step *= 2
    rest = width + 1 - step
    around = F.greatest("__b", "__f", F.lag("__b", rest).over(w), F.lead("__f", rest).over(w))
    # episodes of under two widths have rows that reach neither end: from row 1 to n - width - 1 rows ahead
    running = F.coalesce(F.max("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float("-inf")))
    d = d.withColumns({"__around": around, "__running": F.when(F.col("__n") < 2 * width, running)})
    heads = F.collect_list("__running").over(whole(keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("__heads", heads)
    ahead = i + F.col("__n") - width - 1
    short = F.when(ahead >= 1, F.get("__heads", ahead.cast("int")))
    top = F.when((i < width) & (i + width >= F.col("__n")), short).otherwise(F.col("__around"))
    return d.withColumn("local_peak", floored_peak(top)).drop("__n", "__v", "__b", "__f", "__around", "__running", "__heads")


def _baseline(col: str, rows: int) -> list[Column]:
    v = F.when(F.col("idx") <= rows, F.col(col))
    enough = F.count(F.lit(1)) > rows
    mean, sd = F.when(enough, F.avg(v)), F.when(enough, F.stddev_samp(v))
    return [mean.alias("baseline_mean"), sd.alias("baseline_sd"), (mean + sd).alias("curve_threshold")]


def baseline(df: DataFrame, col: str = "tac", rows: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Mean, spread and their sum over idx 0..rows; null where there are no more than `rows` rows."""
    return df.groupBy(*keys).agg(*_baseline(col, rows))


def _trapezoids(col: str, keys: Sequence[str]) -> dict[str, Column]:
    w = by(keys)
    step = (F.col(col) + F.lag(col).over(w)) / 2
    return {"__step": step, "__time": step * (F.col("hours") - F.lag("hours").over(w))}


def _areas(dx: float) -> list[Column]:
    total = F.sum("__step") * dx
    return [total.alias("auc_total"), (total / F.max("hours")).alias("auc_per_hour"), F.sum("__time").alias("auc_time")]


def area(df: DataFrame, col: str = "tac", dx: float = 0.1, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Trapezoids of fixed width, per hour too, and over true time."""
    return df.withColumns(_trapezoids(col, keys)).groupBy(*keys).agg(*_areas(dx))


def _absolute_step(col: str, keys: Sequence[str]) -> dict[str, Column]:
    return {"__d": F.abs(F.col(col) - F.lag(col).over(by(keys)))}


def _mean_step() -> list[Column]:
    return [F.avg("__d").alias("avg_tac_diff")]


def mean_absolute_step(df: DataFrame, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    return df.withColumns(_absolute_step(col, keys)).groupBy(*keys).agg(*_mean_step())


def _with_flips(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    w = by(keys)
    up = df.withColumn("__up", F.col(col) - F.lag(col).over(w) >= 0)
    return up.withColumn("__flip", (F.col("__up") != F.lag("__up").over(w)).cast("long"))


def _flips() -> list[Column]:
    flips, steps = F.coalesce(F.sum("__flip"), F.lit(0)), F.count(F.lit(1)) - 1
    return [flips.alias("alterations"), steps.alias("steps"), F.when(steps > 0, flips * 100.0 / steps).alias("alteration_percent")]


def direction_changes(df: DataFrame, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    """Changes of direction (a step of 0 counts as up), rows less one, and their percentage."""
    return _with_flips(df, col, keys).groupBy(*keys).agg(*_flips())


def signal_totals(df: DataFrame, col: str = "tac", rows: int = 10, dx: float = 0.1, keys: Sequence[str] = EPISODE) -> DataFrame:
    """`mean_sd_sem`, `baseline`, `area`, `mean_absolute_step` and `direction_changes` in one row: readings are shuffled and sorted once for all."""
    d = _with_flips(df.withColumns(_trapezoids(col, keys) | _absolute_step(col, keys)), col, keys)
    return d.groupBy(*keys).agg(*_spread(col), *_baseline(col, rows), *_areas(dx), *_mean_step(), *_flips())


def sampling_rate(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    seconds = F.unix_micros("ts") / 1e6
    step = seconds - F.lag(seconds).over(by(keys))
    return df.withColumn("__s", step).groupBy(*keys).agg(F.bround(F.try_divide(F.lit(60), F.avg("__s"))).alias("sampling_rate"))


def value_proportion(df: DataFrame, col: str, value, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Share of rows equal to `value`; rows without a value count as unequal."""
    return df.groupBy(*keys).agg(F.avg(F.coalesce((F.col(col) == value).cast("double"), F.lit(0.0))).alias("proportion"))


def flag_counts(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = EPISODE) -> DataFrame:
    """How many rows of an episode each flag marks; an unset flag counts as 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f"{f}_count") for f in flags])


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = EPISODE) -> DataFrame:
    """(keys, col, n): rows of each value, null being one."""
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))


def wear_statistics(df: DataFrame, cutoff: float = 27.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Hours and percentages off and on the body, by temperature over `cutoff`; 0 without temperatures."""
    off = F.coalesce(F.avg(F.when(F.col("temp").isNotNull(), (F.col("temp") <= cutoff).cast("double"))), F.lit(0.0))
    return df.groupBy(*keys).agg((off * 100).alias("not_worn_percent"), F.max("hours").alias("__h"), off.alias("__off"), F.count("temp").alias("__n")).select(
        *keys, "not_worn_percent", (F.col("__off") * F.col("__h")).alias("not_worn_hours"), F.when(F.col("__n") > 0, (1 - F.col("__off")) * F.col("__h")).otherwise(0.0).alias("worn_hours"), F.when(F.col("__n") > 0, 100 - F.col("not_worn_percent")).otherwise(0.0).alias("worn_percent")
    )


def quality_control(df: DataFrame, min_active_h: float = 1.0, max_inactive_pct: float = 30.0, max_imputed_pct: float = 65.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Inactive and imputed shares and hours, and whether the episode passes.

    `df` has motion, and the flags device_on (null: unknown), gap_imputed, device_off_imputed,
    major_outlier and minor_outlier where they are known; missing flags count as unset.
    """
    def flag(name: str, unset=0) -> Column:
        return F.coalesce(F.col(name).cast("int"), F.lit(unset)) if name in df.columns else F.lit(unset)

    inactive = ((F.coalesce(F.col("motion"), F.lit(0.0)) == 0) | (flag("device_on", 1) == 0)).cast("double")
    imputed = F.greatest(flag("gap_imputed"), flag("device_off_imputed"), flag("extreme_outlier"), flag("major_outlier"), flag("minor_outlier")).cast("double")
    got = df.groupBy(*keys).agg(F.avg(inactive).alias("__i"), F.avg(imputed).alias("__m"), F.max("hours").alias("__h"))
    got = got.select(*keys, (F.col("__i") * 100).alias("inactive_percent"), (F.col("__i") * F.col("__h")).alias("inactive_hours"), ((1 - F.col("__i")) * F.col("__h")).alias("active_hours"), (F.col("__m") * 100).alias("imputed_percent"), (F.col("__m") * F.col("__h")).alias("imputed_hours"))
    reason = F.when(F.col("inactive_percent") >= max_inactive_pct, "inactive").when(F.col("active_hours") <= min_active_h, "short").when(F.col("imputed_percent") > max_imputed_pct, "imputed")
    return got.withColumns({"invalid_reason": reason, "valid": reason.isNull().cast("int")})


def confusion(df: DataFrame, truth: str = "truth", predicted: str = "predicted", positive="1", negative="0") -> DataFrame:
    """Counts, accuracy, sensitivity and specificity in one row."""
    t, p = F.col(truth), F.col(predicted)

    def n(a, b) -> Column:
        return F.coalesce(F.sum(((t == a) & (p == b)).cast("long")), F.lit(0))

    return df.agg(n(positive, positive).alias("tp"), n(negative, negative).alias("tn"), n(negative, positive).alias("fp"), n(positive, negative).alias("fn")).withColumns({
        "accuracy": (F.col("tp") + F.col("tn")) / F.nullif(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.lit(0)),
        "sensitivity": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)),
        "specificity": F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0)),
    })


def quartiles(df: DataFrame, col: str, group: Sequence[str]) -> DataFrame:
    """Box plot figures of `col` for each group."""
    return df.groupBy(*group).agg(F.min(col).alias("low"), *[F.percentile(col, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(col).alias("high"))


def histogram(df: DataFrame, col: str = "temp", low: float = 20, high: float = 40, step: float = 2) -> DataFrame:
    """Counts in bins [low, low + step), ...; the last bin takes its upper end too."""
    v = F.col(col)
    bin_of = F.when(v == high, int((high - low) / step) - 1).otherwise(F.floor((v - low) / step))
    return df.where((v >= low) & (v <= high)).groupBy((F.lit(low) + bin_of * step).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def r_squared(df: DataFrame, y: str, fitted: str) -> DataFrame:
    left = F.sum((F.col(y) - F.col(fitted)) ** 2)
    return df.agg((1 - left / (F.var_pop(y) * F.count(y))).alias("r2"))
