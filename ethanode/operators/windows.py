"""Positional operators: numbering, neighbours, slopes, curvature, runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE = ("episode",)


def by(keys: Sequence[str], order: str = "idx"):
    return Window.partitionBy(*keys).orderBy(order)


def backwards(keys: Sequence[str], order: str = "idx"):
    """From the last row to the first: what looks at all rows that follow is a running frame here, where one to the end would be computed anew for each row."""
    return Window.partitionBy(*keys).orderBy(F.col(order).desc())


def whole(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def numbered(df: DataFrame, keys: Sequence[str] = EPISODE, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """`df` with idx (dense from 0) and hours since the episode's first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seconds = F.unix_micros("ts") / 1e6
    return df.withColumns({"idx": (F.row_number().over(w) - 1).cast("long"), "hours": (seconds - F.first(seconds).over(w)) / 3600})


def renumbered(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """idx and hours from 0 again, after rows have gone."""
    w = by(keys)
    return df.withColumns({"hours": F.col("hours") - F.first("hours").over(w), "idx": (F.row_number().over(w) - 1).cast("long")})


def _differences(col: str, keys: Sequence[str]) -> dict[str, Column]:
    w, v = by(keys), F.col(col)
    return {f"{col}_diff_prior": v - F.lag(v).over(w), f"{col}_diff_post": F.lead(v).over(w) - v}


def _mean_changes(col: str, n: int, keys: Sequence[str]) -> dict[str, Column]:
    w, v = by(keys), F.col(col)
    return {f"{col}_mean_change_pre": v - F.avg(v).over(w.rowsBetween(-n, -1)), f"{col}_mean_change_post": v - F.avg(v).over(w.rowsBetween(1, n))}


def neighbour_differences(df: DataFrame, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    return df.withColumns(_differences(col, keys))


def neighbour_mean_changes(df: DataFrame, col: str = "tac", n: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    return df.withColumns(_mean_changes(col, n, keys))


def rolling_slope(df: DataFrame, col: str = "tac", n: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Least-squares slope over the n rows before; null with fewer than two."""
    w = by(keys).rowsBetween(-n, -1)
    x, y = F.col("idx").cast("double"), F.col(col)
    slope = (F.avg(x * y).over(w) - F.avg(x).over(w) * F.avg(y).over(w)) / (F.avg(x * x).over(w) - F.avg(x).over(w) * F.avg(x).over(w))
    return df.withColumn(f"{col}_slope", F.when(F.count(y).over(w) >= 2, slope))


def _quadratic(m: Column, sums: Sequence[Column], span: Column, backward: bool) -> dict[str, Column]:
    """Coefficients a, b, c of a least-squares parabola through m values at evenly spaced x over [0, span], from the sums of y, i * y and i * i * y over their places i; x is centred and scaled, so the normal equations are two small ones. `backward` takes the last value first."""
    y0, first, second = sums
    half = (m - 1) / 2
    s2 = m * (m * m - 1) / 12
    s4 = s2 * (3 * m * m - 7) / 20
    y1 = half * y0 - first if backward else first - half * y0
    y2 = second - 2 * half * first + half * half * y0
    a = (m * y2 - s2 * y0) / (m * s4 - s2 * s2)
    b = y1 / s2
    c = (y0 - a * s2) / m
    scale = (m - 1) / span  # u = x * scale - half
    return {"a": a * scale * scale, "b": b * scale - 2 * a * scale * half, "c": a * half * half - b * half + c}


_SIDES = ("pre", "post")


def _around(col: str, n: int, keys: Sequence[str]) -> dict[str, Column]:
    """Of both sides of a row, the values with its own and the minutes spanned."""
    w, minutes, out = by(keys), F.col("hours") * 60, {}
    for side, frame in zip(_SIDES, (w.rowsBetween(-n, 0), w.rowsBetween(0, n)), strict=True):
        out[f"__{col}_{side}"] = F.collect_list(F.col(col)).over(frame)
        out[f"__span_{side}"] = F.max(minutes).over(frame) - F.min(minutes).over(frame)
    return out


def _sums(col: str, n: int) -> dict[str, Column]:
    """Number of the values and their sums with powers of their places, written out: functions over arrays are interpreted for every row."""
    out = {}
    for name in [f"__{col}_{side}" for side in _SIDES]:
        each = [F.coalesce(F.get(name, F.lit(i)), F.lit(0.0)) for i in range(n + 1)]
        out[f"{name}_m"] = F.size(name).cast("double")
        for k in range(3):
            out[f"{name}_{k}"] = reduce(Column.__add__, [y * float(i**k) for i, y in enumerate(each)])
    return out


def _parabolas(col: str, least: int, reversed_prior: bool) -> dict[str, Column]:
    out = {}
    for side in _SIDES:
        m, *sums = (F.col(f"__{col}_{side}_{k}") for k in ("m", 0, 1, 2))
        span = F.col(f"__span_{side}")
        fits = _quadratic(m, sums, span, side == "pre" and reversed_prior)
        out |= {f"{col}_{k}_{side}": F.when((m > least) & (span > 0), c) for k, c in fits.items()}
    return out


def quadratic_fits(df: DataFrame, col: str = "tac", n: int = 10, least: int = 5, keys: Sequence[str] = EPISODE, reversed_prior: bool = True) -> DataFrame:
    """a, b, c of parabolas through a row and up to n rows before (pre) and after (post).

    x runs evenly over the minutes spanned, from 0. Rows with fewer than `least` neighbours
    on a side have null there. `reversed_prior` fits the rows before nearest first, as the
    published tool does.
    """
    around, sums = _around(col, n, keys), _sums(col, n)
    return df.withColumns(around).withColumns(sums).withColumns(_parabolas(col, least, reversed_prior)).drop(*around, *sums)


def row_features(df: DataFrame, cols: Sequence[str] = ("temp", "motion"), n: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Value, parabolas, mean changes and changes on both sides, for each of `cols`.

    The windows of a column come after the sums of the one before: the sums of all columns at
    once would be one generated method, too long for the JVM to compile.
    """
    found, changes, names = df, {}, []
    for c in cols:
        own, more = _parabolas(c, 5, True), _differences(c, keys) | _mean_changes(c, n, keys)
        found = quadratic_fits(found, c, n, keys=keys)
        names += [*own, *more]
        changes |= more
    return found.withColumns(changes).select(*[c for c in df.columns if c not in names], *names)


def returns_to_baseline(df: DataFrame, col: str = "tac", n: int = 120, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Whether any of the next n rows is back beyond the mean of the three before, against the jump's direction."""
    w, v = by(keys), F.col(col)
    before, ahead = F.avg(v).over(w.rowsBetween(-3, -1)), w.rowsBetween(0, n - 1)
    return df.withColumn("returns", F.when(v >= before, F.min(v).over(ahead) <= before).otherwise(F.max(v).over(ahead) >= before))


def runs(df: DataFrame, value: Column, gap: float, keys: Sequence[str] = EPISODE) -> DataFrame:
    """`df` with run, numbered from 0: a new one starts where `value` grew by more than `gap`."""
    w = by(keys)
    return df.withColumn("run", F.sum(F.when(value - F.lag(value).over(w) > gap, 1).otherwise(0)).over(w).cast("long"))


def without_ends(df: DataFrame, n: int = 10, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Each episode without its first and last n rows."""
    last = F.count(F.lit(1)).over(whole(keys))
    return df.withColumn("__n", last).where((F.col("idx") >= n) & (F.col("idx") < F.col("__n") - n)).drop("__n")


def head_and_tail(df: DataFrame, n: int, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Each episode's first and last n rows, no row twice."""
    last = F.count(F.lit(1)).over(whole(keys))
    return df.withColumn("__n", last).where((F.col("idx") < n) | (F.col("idx") >= F.col("__n") - n)).drop("__n")


def first_groups(df: DataFrame, group: str, n: int, order: str) -> DataFrame:
    """The rows of the n groups that appear first by `order`."""
    chosen = df.groupBy(group).agg(F.min(order).alias("__first")).orderBy("__first").limit(n).select(group)
    return df.join(chosen, group, "left_semi")


def standardized(df: DataFrame, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    """<col>_z: the distance from the episode's mean in standard deviations; null with one value, and where all values are the same what floating point has for a division by zero: NaN."""
    w, v = whole(keys), F.col(col)
    away, sd = v - F.avg(v).over(w), F.stddev_samp(v).over(w)
    return df.withColumn(f"{col}_z", F.when(sd == 0, away * F.lit(float("inf"))).otherwise(away / sd))


def baseline_corrected(df: DataFrame, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    return df.withColumn(f"{col}_baseline", F.col(col) - F.least(F.min(col).over(whole(keys)), F.lit(0.0)))


def sorted_by_text(df: DataFrame, col: str) -> DataFrame:
    """Rows in the order of a text column whatever its case; the exact text breaks ties."""
    return df.orderBy(F.lower(col), col)
