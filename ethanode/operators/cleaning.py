"""Cleaning of the signal: start, negatives, gaps, extremes, removal of the device, artifacts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from math import gamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethanode.operators.windows import EPISODE, backwards, by, numbered, whole


def sloped_start(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """A start that falls steeply (slope under -3 over rows 0..12, minimum under 10) becomes 0 there; sloped_start marks rows 0..11."""
    w = whole(keys)
    head = F.col("idx") <= 12
    x, y = F.when(head, F.col("idx").cast("double")), F.when(head, F.col("tac"))
    slope = F.try_divide(F.avg(x * y).over(w) - F.avg(x).over(w) * F.avg(y).over(w), F.avg(x * x).over(w) - F.avg(x).over(w) * F.avg(x).over(w))
    d = df.withColumn("__sloped", F.coalesce((slope < -3) & (F.min(y).over(w) < 10) & (F.count(y).over(w) >= 2), F.lit(False)))
    return d.withColumns({"sloped_start": (F.col("__sloped") & (F.col("idx") <= 11)).cast("int"), "tac": F.when(F.col("__sloped") & head, 0.0).otherwise(F.col("tac"))}).drop("__sloped")


def negatives_to_zero(df: DataFrame, parity: bool = False) -> DataFrame:
    """Negative and missing values are 0; the flag marks the negative ones (with parity, the positive ones)."""
    flag = F.col("tac") > 0 if parity else F.col("tac") < 0
    return df.withColumns({"negative_reassigned_zero": F.coalesce(flag, F.lit(False)).cast("int"), "tac": F.greatest(F.coalesce("tac", F.lit(0.0)), F.lit(0.0))})


def gaps(df: DataFrame, gap_h: float = 0.5, keys: Sequence[str] = EPISODE) -> DataFrame:
    """(keys, before, start, length_h, missing rows) of every pause longer than gap_h."""
    step = F.col("hours") - F.lag("hours").over(by(keys))
    d = df.withColumns({"__gap": step, "__from": F.lag("ts").over(by(keys))}).where(F.col("__gap") > gap_h)
    return d.select(*keys, (F.col("idx") - 1).alias("before"), F.col("__from").alias("start"), F.col("__gap").alias("length_h"))


def insert_gap_rows(df: DataFrame, gap_h: float = 0.5, rate: float = 1.0, least_rows: float = 60, keys: Sequence[str] = EPISODE, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Rows each `rate` minutes in pauses longer than gap_h, without values, marked gap_imputed.

    They take everything else from the row after. Only for episodes of more than
    `least_rows` / rate rows. idx and hours are numbered anew.
    """
    w = by(keys)
    step = F.col("hours") - F.lag("hours").over(w)
    d = df.withColumns({"__prev": F.lag("ts").over(w), "__m": F.when((step > gap_h) & (F.count(F.lit(1)).over(whole(keys)) * rate > least_rows), F.floor(step * 60 / rate).cast("int")).otherwise(0)})
    # each row comes with the new ones before it, so that what made the rows runs once
    d = d.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__m"))))
    new = F.col("__k") > 0
    d = d.withColumns({"ts": F.when(new, F.col("__prev") + F.make_dt_interval(secs=F.col("__k") * F.lit(60.0 * rate))).otherwise(F.col("ts")), "tac": F.when(~new, F.col("tac")), "gap_imputed": new.cast("int")})
    return numbered(d.drop("__prev", "__m", "__k"), keys, [*order, "gap_imputed"])


def bridge_extremes(df: DataFrame, cutoff: float = 800.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Runs of values over the cutoff become the mean of the values beside them; at an end of the episode they stay, marked all the same.

    Only for episodes of more than 30 rows and a range over 5.
    """
    w = by(keys)
    high = F.col("tac") > cutoff
    ok = F.when(~high, F.col("tac"))
    before = F.last(ok, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(ok, ignorenulls=True).over(backwards(keys).rowsBetween(Window.unboundedPreceding, -1))
    wanted = (F.count(F.lit(1)).over(whole(keys)) > 30) & (F.max("tac").over(whole(keys)) - F.min("tac").over(whole(keys)) > 5)
    d = df.withColumns({"__hit": F.coalesce(high & wanted, F.lit(False)), "__mid": (before + after) / 2})
    return d.withColumns({"extreme_outlier": F.col("__hit").cast("int"), "tac": F.when(F.col("__hit") & F.col("__mid").isNotNull(), F.col("__mid")).otherwise(F.col("tac"))}).drop("__hit", "__mid")


#: Sums of squares that are held at a time: 8 MB.
HELD_COSTS = 1_000_000


def clusters_of(values: np.ndarray, most: int = 9) -> tuple[list[float], list[np.ndarray]]:
    """For k = 1 to `most` clusters of numbers, the least sum of squares and each number's cluster (from 0 up): exact, by dynamic programming over the sorted distinct ones."""
    distinct, place, weight = np.unique(values, return_inverse=True, return_counts=True)
    n, mean = len(distinct), float(np.average(distinct, weights=weight))
    centred = distinct - mean
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weight, weight * centred, weight * centred**2))
    lo = np.arange(n)

    def within(a: int, b: int) -> np.ndarray:
        """The sum of squares of one cluster from each place (columns) up to each of the ends a + 1 to b (rows)."""
        j = np.arange(a + 1, b + 1)[:, None]
        inside = lo < j
        return np.where(inside, np.maximum(q[j] - q[lo] - (s[j] - s[lo]) ** 2 / np.where(inside, w[j] - w[lo], 1.0), 0.0), np.inf)

    step = max(1, HELD_COSTS // max(n, 1))
    held = within(0, n) if step >= n else None  # the same for every k; of more numbers, made anew a part at a time
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    cuts, costs, labels = [], [], []
    for k in range(1, min(most, n) + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for a in range(0, n, step):
            b = min(a + step, n)
            cost = best[:n] + (within(a, b) if held is None else held)
            cut[a + 1 : b + 1] = at = cost.argmin(axis=1)
            new[a + 1 : b + 1] = cost[np.arange(b - a), at]
        best = new
        cuts.append(cut)
        own, j = np.zeros(n, int), n
        for level in range(k, 0, -1):
            own[cuts[level - 1][j] : j] = level - 1
            j = cuts[level - 1][j]
        costs.append(float(best[n]))
        labels.append(own[place])
    return costs, labels


def cluster_to_drop(values: np.ndarray, labels: np.ndarray, gap: float) -> int | None:
    """In order of appearance, the last cluster that lies over the one before it by more than `gap`."""
    seen = list(dict.fromkeys(labels.tolist()))
    low, high = {c: values[labels == c].min() for c in seen}, {c: values[labels == c].max() for c in seen}
    return next((c for b, c in reversed(list(zip(seen, seen[1:], strict=False))) if low[c] - high[b] > gap), None)


def drop_clusters(df: DataFrame, over: float = 600.0, gap: float = 200.0, most: int = 9, keys: Sequence[str] = EPISODE) -> DataFrame:
    """The variant of `bridge_extremes` by clusters: in episodes with a value over `over`, the values of a cluster that lies apart are filled, marked extreme_outlier.

    The number of clusters is that at the knee of their sums of squares; clusters are exact, so
    the same values always give the same ones.
    """

    def compute(rows: pa.Table):
        v = _numbers(rows, "tac")
        known, hit = np.isfinite(v), np.zeros(len(v), bool)
        if known.any() and v[known].max() > over:
            costs, labels = clusters_of(v[known], most)
            own = labels[knee(costs) - 1]
            gone = cluster_to_drop(v[known], own, gap)
            if gone is not None:
                hit[np.flatnonzero(known)[own == gone]] = True
        return {"tac": filled(v, _numbers(rows, "hours"), hit) if hit.any() else v, "extreme_outlier": hit}

    return per_episode(df, {"tac": pa.float64(), "extreme_outlier": pa.int32()}, compute, keys)


def knee(costs: Sequence[float]) -> int:
    """The k (from 1) where a falling, convex curve lies farthest under the line between its ends."""
    n, lo, hi = len(costs), min(costs), max(costs)
    if n < 3 or hi == lo:
        return 1
    return 1 + max(range(n), key=lambda i: (1 - i / (n - 1)) - (costs[i] - lo) / (hi - lo))


def worn(df: DataFrame, cutoff: float = 27.0) -> DataFrame:
    """device_on: 1 over the cutoff, 0 at or under it, null without a temperature."""
    return df.withColumn("device_on", F.when(F.col("temp").isNotNull(), (F.col("temp") > cutoff).cast("int")))


def zero_high_baseline(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """A start over 10 in rows 0..5 that three rows under 3 follow by idx 15: the head up to the third becomes 0."""
    w = whole(keys)
    low = F.when((F.col("idx") <= 15) & (F.col("tac") < 3), F.col("idx"))
    d = df.withColumns({"__peak": F.max(F.when(F.col("idx") <= 5, F.col("tac"))).over(w), "__third": F.get(F.array_sort(F.collect_set(low).over(w)), F.lit(2))})
    return d.withColumn("tac", F.when((F.col("__peak") > 10) & (F.col("idx") < F.col("__third")), 0.0).otherwise(F.col("tac"))).drop("__peak", "__third")


def kept_in_steps(micros: np.ndarray, least: int) -> list[int]:
    """Places of ascending times that stay if each comes `least` or more after the last one that stayed."""
    kept, at = [], 0
    while at < len(micros):
        kept.append(at)
        at = max(at + 1, int(np.searchsorted(micros, micros[at] + least)))
    return kept


def thinning(df: DataFrame, seconds: float = 59.0, keys: Sequence[str] = EPISODE, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The rows that greedy thinning leaves: one stays if it comes `seconds` or more after the last row that stayed; rows without a time go.

    Each choice rests on the one before it, so an episode is gone through in one pass, by
    searches in its sorted times.
    """
    least = round(seconds * 1e6)

    def keep(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows.column("ts"))).sort_by([(c, "ascending") for c in order])
        return rows.take(pa.array(kept_in_steps(rows.column("ts").cast(pa.int64()).to_numpy(), least), pa.int64()))

    return df.groupBy(*keys).applyInArrow(keep, df.schema)


def thinned(df: DataFrame, seconds: float = 59.0, keys: Sequence[str] = EPISODE, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """`thinning`, numbered anew."""
    return numbered(thinning(df, seconds, keys, order), keys, order)


def thinned_where_dense(df: DataFrame, seconds: float = 59.0, keys: Sequence[str] = EPISODE, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """`df` with the episodes thinned that have more than one row a minute, by the rounded mean; the others stay as they are."""
    w = whole(keys)
    span = (F.unix_micros(F.max("ts").over(w)) - F.unix_micros(F.min("ts").over(w))) / 1e6
    dense = F.coalesce(F.bround(F.try_divide(60 * (F.count("ts").over(w) - 1), span)) > 1, span == 0, F.lit(False)) & (F.count("ts").over(w) > 1)
    marked = df.withColumn("__dense", dense)
    return thinning(marked.where("__dense").drop("__dense"), seconds, keys, order).unionByName(marked.where("not __dense").drop("__dense"))


# --- gaps of values, filled from the rows around them -------------------------------------


def missing_runs(missing: np.ndarray, extend: int, merge: int) -> list[tuple[int, int]]:
    """Runs [lo, hi) of missing places, each extended to the right (the last by a third), then joined where `merge` or less lies between."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], missing.astype(np.int8), [0]]))).reshape(-1, 2)
    n, out = len(missing), []
    for i, (lo, hi) in enumerate(edges):
        more = extend if i + 1 < len(edges) else round(extend / 3)
        limit = edges[i + 1][0] if i + 1 < len(edges) else n
        hi = min(hi + more, limit)
        if out and lo - out[-1][1] < merge:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((int(lo), int(hi)))
    return out


#: The scaled distance beyond which the Matern correlation counts as 0.
FARTHEST = 60.0


@functools.lru_cache(maxsize=8)
def _matern_table(nu: float) -> tuple[np.ndarray, np.ndarray]:
    """The Matern correlation at scaled distances from 0 to the farthest, by quadrature of the Bessel function K."""
    x = np.concatenate([[0.0], np.geomspace(1e-8, FARTHEST, 4000)])
    t = np.linspace(0, 32, 1200)  # far enough for the smallest distance
    k = np.trapezoid(np.exp(-np.clip(x[1:, None] * np.cosh(t), 0, 700)) * np.cosh(nu * t), t, axis=1)
    return x, np.concatenate([[1.0], np.minimum(2 ** (1 - nu) / gamma(nu) * x[1:] ** nu * k, 1.0)])


def matern(d: np.ndarray, length: float, nu: float) -> np.ndarray:
    x, y = _matern_table(nu)
    return np.interp(np.sqrt(2 * nu) * np.abs(d) / length, x, y, right=0.0)


#: Added to a row's own correlation, so that equal rows do no harm.
_NUGGET = 1e-8


def toeplitz_solved(first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, half the logarithm of the determinant) of the symmetric Toeplitz system with this first row, by Levinson's recursion: the square of its size in place of the cube."""
    n = len(y)
    r = first[1:] / first[0]
    b = y / first[0]
    x, z = np.zeros(n), np.zeros(n)
    x[0], error, log_error = b[0], 1.0, 0.0
    if n > 1:
        z[0] = -r[0]
    for k in range(1, n):
        error *= 1 - z[k - 1] ** 2
        if not error > 0:
            raise np.linalg.LinAlgError("not positive definite")
        log_error += log(error)
        step = (b[k] - r[:k] @ x[k - 1 :: -1][:k]) / error
        x[:k] += step * z[k - 1 :: -1][:k]
        x[k] = step
        if k < n - 1:
            turn = -(r[k] + r[:k] @ z[k - 1 :: -1][:k]) / error
            z[:k] += turn * z[k - 1 :: -1][:k].copy()
            z[k] = turn
    return x, (n * log(first[0]) + log_error) / 2


class Correlations:
    """The Matern correlations of rows at these times; for rows on an even grid each distance is computed once, and without a hole in it the system is a Toeplitz one."""

    def __init__(self, x: np.ndarray, nu: float):
        self.x, self.nu = x, nu
        steps = np.diff(x)
        unit = steps.min() if len(steps) and steps.min() > 0 else 0.0
        places = (x - x[0]) / unit if unit else np.zeros(0)
        on_grid = bool(unit) and np.abs(places - np.round(places)).max() < 1e-4 and places[-1] < 20 * len(x)
        self.places, self.unit = (np.round(places).astype(int), unit) if on_grid else (None, 0.0)
        self.even = on_grid and int(self.places[-1]) == len(x) - 1
        self.lags = None if self.even else np.abs(self.places[:, None] - self.places[None, :]) if on_grid else np.abs(x[:, None] - x[None, :])

    def loss_of(self, y: np.ndarray) -> Callable[[float], float]:
        """`fitted`'s loss as a function of the length, without the weights.

        Where the rows are uneven, the matrix is bordered by the values, so that its Cholesky
        factor has all that a loss takes: the determinant in the diagonal, and in the last row
        numbers whose squares add up to values times weights. What no length changes is laid
        out once.
        """
        if self.even:
            return lambda length: self.fitted(y, length)[0]
        n = len(y)
        full = np.zeros((n + 1, n + 1))
        cells, own = full.reshape(-1), np.arange(n) * (n + 2)
        cells[own], full[n, :n], full[n, n] = 1 + _NUGGET, y, 1e300  # the corner is large enough for any values
        row, col = np.tril_indices(n, -1)
        lags = self.lags[row, col]
        order = np.argsort(lags)  # ascending distances are found in the table of correlations much faster
        below, lags = (row * (n + 1) + col)[order], lags[order]
        grid = None if self.places is None else self.unit * np.arange(self.places[-1] + 1)
        least = (lags[0] if grid is None else grid[lags[0]]) if len(lags) else np.inf
        apart: list[float] = []  # the loss of all lengths for which no two rows correlate

        def loss(length: float) -> float:
            alone = sqrt(2 * self.nu) * least / length > FARTHEST
            if alone and apart:
                return apart[0]
            cells[below] = matern(lags, length, self.nu) if grid is None else matern(grid, length, self.nu)[lags]
            try:
                factor = np.linalg.cholesky(full)
            except np.linalg.LinAlgError:
                return np.inf
            last = factor[n, :n]
            found = n * log(max(float(last @ last) / n, 1e-12)) / 2 + float(np.log(factor.reshape(-1)[own]).sum())
            if alone:
                apart.append(found)
            return found

        return loss

    def fitted(self, y: np.ndarray, length: float) -> tuple[float, np.ndarray]:
        """(loss, weights) for this length: the negative logarithm of the likelihood, but for constants, at its best scale, which has a closed form."""
        try:
            if self.even:
                first = matern(self.unit * np.arange(len(y)), length, self.nu)
                first[0] += _NUGGET
                alpha, half_log = toeplitz_solved(first, y)
            else:
                full = matern(self.unit * np.arange(self.places[-1] + 1), length, self.nu)[self.lags] if self.places is not None else matern(self.lags, length, self.nu)
                full[np.diag_indices_from(full)] += _NUGGET
                half_log = float(np.log(np.diag(np.linalg.cholesky(full))).sum())
                alpha = np.linalg.solve(full, y)
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(len(y))
        return len(y) * log(max(float(y @ alpha) / len(y), 1e-12)) / 2 + half_log, alpha


def _best_length(loss, low: float = -3.0, high: float = 3.0, points: int = 13, rounds: int = 9) -> float:
    """The length between 10**low and 10**high of least loss: a grid, then golden sections beside its best point; the grid's point where the sections find no better one."""
    grid = np.linspace(low, high, points)
    losses = [loss(10**g) for g in grid]
    at = int(np.argmin(losses))
    a, b = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    tried = {grid[at]: losses[at], c: loss(10**c), d: loss(10**d)}
    for _ in range(rounds):
        if tried[c] < tried[d]:
            b, d = d, c
            c = b - ratio * (b - a)
            tried[c] = loss(10**c)
        else:
            a, c = c, d
            d = a + ratio * (b - a)
            tried[d] = loss(10**d)
    return 10 ** min(tried, key=tried.get)


def predicted(x: np.ndarray, y: np.ndarray, at: np.ndarray, method: str) -> np.ndarray:
    """Values at `at`: a straight line, interpolation, or a Gaussian process with a Matern kernel whose length and scale are those of greatest likelihood.

    The line is also what a Gaussian process with the dot-product kernel and next to no noise gives.
    """
    if len(x) < 2:
        return np.full(len(at), y[0] if len(y) else 0.0)
    if method == "line":
        mid, middle = y.sum() / len(y), x.sum() / len(x)
        off = x - middle
        spread = float(off @ off)
        return mid + (float(off @ y) / spread if spread else 0.0) * (at - middle)
    if method == "interpolate" or not y.any():
        return np.interp(at, x, y)
    rows = Correlations(x, 0.3)
    length = _best_length(rows.loss_of(y))
    loss, weights = rows.fitted(y, length)
    return np.interp(at, x, y) if loss == np.inf else matern(at[:, None] - x[None, :], length, 0.3) @ weights


def local_peak(v: np.ndarray, i: int, width: int = 100) -> float:
    """The highest value about row i, at least 1 where it is not over 0.5; the stretch is one row short at the start and, near the end, as long as the published tool has it."""
    ahead = width if i + width < len(v) else len(v) - width - 1
    stretch = v[max(i - width, 1 if i <= width else i - width) : max(i + ahead + 1, 0)]
    stretch = stretch[np.isfinite(stretch)]
    top = stretch.max() if len(stretch) else 1.0
    return float(top) if top > 0.5 else 1.0


def rows_beside(lo: int, hi: int, n: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows before and after a gap [lo, hi) that its filling may learn from."""
    span = limit * n
    before = np.arange(max(0, lo - max(30, int(0.1 * n)) - 1), lo)
    return before, np.arange(hi, min(n, hi + (int(span / 2) if span > 75 else 30) + 1))


def without_jumps(rows: np.ndarray, v: np.ndarray, reject: float | None) -> np.ndarray:
    """`rows` without those that jump from the row before them by a share of the rows' peak (in logarithms) over `reject`."""
    if reject is None or len(rows) < 2:
        return rows
    known = v[rows]
    top = np.nanmax(known) if np.isfinite(known).any() else 1.0
    step = np.abs(np.diff(known, prepend=known[0]))
    jumps = (step > 1) & (np.log(np.maximum(step, 1e-12)) / (np.log(max(top, 1e-12)) + 1e-4) > reject) if top > 3 else np.zeros(len(rows), bool)
    return rows[~jumps]


def filled(values: np.ndarray, hours: np.ndarray, missing: np.ndarray, *, extend: int = 0, limit: float = 0.7, side: str = "both", method: str = "matern", merge: int = 15, reject: float | None = None) -> np.ndarray:
    """`values` with the missing runs filled from rows before and after; runs too long for that become 0.

    side `flex` learns from the rows before alone if less than an hour follows the gap, or if
    the values rise across it by over 10 and by over half of the peak. Runs that lie apart are
    filled apart, also without extension (where the published tool makes them one).
    """
    n, out = len(values), values.copy()
    out[missing] = np.nan
    source = out.copy()
    for lo, hi in missing_runs(missing, extend, merge):
        if hi - lo >= limit * n:
            continue
        before, after = rows_beside(lo, hi, n, limit)
        use = side if len(after) else "left"
        if use == "flex":
            rise = source[after[0]] - source[before[-1]] if len(before) else 0.0
            peak = local_peak(source, max(len(before) - 1, 0))  # the place within the rows before, as published
            use = "left" if len(before) and (hours[-1] - hours[after[0]] < 1 or (abs(rise) / peak > 0.5 and rise > 10)) else "both"
        before, after = without_jumps(before, source, reject), without_jumps(after, source, reject)
        rows = before if use == "left" else after if use == "right" else np.concatenate([before, after])
        rows = rows[np.isfinite(source[rows])]
        if len(rows):
            out[lo:hi] = predicted(hours[rows], source[rows], hours[lo:hi], method)
    return np.nan_to_num(np.maximum(out, 0.0), nan=0.0)


def per_episode(df: DataFrame, added: Mapping[str, pa.DataType], compute: Callable[[pa.Table], Mapping[str, object]], keys: Sequence[str] = EPISODE) -> DataFrame:
    """`df` with the columns of `added`, which replace those of their names: computed for each episode, its rows by idx, in Arrow batches."""
    replaced = {c.lower() for c in added}
    kinds = {pa.float64(): "double", pa.int32(): "int"}
    old = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name.lower() not in replaced]
    schema = ", ".join([*old, *[f"`{c}` {kinds[t]}" for c, t in added.items()]])

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        found = compute(rows)
        rows = rows.drop_columns([c for c in rows.column_names if c.lower() in replaced])
        for c, kind in added.items():
            values = found[c]
            rows = rows.append_column(c, values if isinstance(values, pa.Array) else pa.array(np.asarray(values).astype(kind.to_pandas_dtype())))
        return rows

    return df.groupBy(*keys).applyInArrow(one, schema)


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return rows.column(column).cast(pa.float64()).to_numpy()


def filled_where(v: np.ndarray, hours: np.ndarray, hit: np.ndarray, **how) -> np.ndarray:
    """`filled`, values that are missing anyway included; untouched where none is."""
    gone = hit | ~np.isfinite(v)
    return filled(v, hours, gone, **how) if gone.any() else v


def fill_missing(df: DataFrame, missing: str, out: str, *, col: str = "tac", keys: Sequence[str] = EPISODE, **how) -> DataFrame:
    """`df` with `out`: `col` filled where `missing` is true. One episode per group: a day of readings at most."""

    def compute(rows: pa.Table):
        hit = rows.column(missing).fill_null(False).to_numpy()
        return {out: filled_where(_numbers(rows, col), _numbers(rows, "hours"), hit, **how)}

    return per_episode(df, {out: pa.float64()}, compute, keys)


def fill_linear(df: DataFrame, missing: str, out: str, col: str = "tac", keys: Sequence[str] = EPISODE) -> DataFrame:
    """`out`: linear in time between the rows around each missing run, native; at an end of the episode the value beside it."""
    w = by(keys)
    known = F.when(~F.coalesce(F.col(missing), F.lit(False)), F.struct(F.col("hours").alias("h"), F.col(col).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.last(known, ignorenulls=True).over(backwards(keys).rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumns({"__a": a, "__b": b})
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("hours") - F.col("__a.h")) / (F.col("__b.h") - F.col("__a.h"))
    value = F.when(known.isNotNull(), F.col(col)).when(F.col("__b.h") > F.col("__a.h"), line).otherwise(F.coalesce("__a.v", "__b.v", F.lit(0.0)))
    return d.withColumn(out, value).drop("__a", "__b")


def device_removal_filled(df: DataFrame, cutoff: float = 27.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """tac with the rows off the body filled; device_off_imputed marks values that changed."""
    d = worn(df, cutoff).withColumn("__off", F.coalesce(F.col("device_on") == 0, F.lit(False)))
    d = fill_missing(d, "__off", "__filled", keys=keys, extend=15, limit=0.9, side="flex", method="matern")
    return d.withColumns({"device_off_imputed": (F.col("__filled") != F.col("tac")).cast("int"), "tac": F.col("__filled")}).drop("__off", "__filled")


def without_artifacts(v: np.ndarray, hours: np.ndarray, major: float = 0.8, minor: float = 0.5, share: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signal without sudden jumps, and the places of major and minor artifacts.

    One walk after the other goes through the rows; what is found is filled at once by a line
    through the rows beside it as they were recorded, and later rows are compared with the
    filled values. A major artifact goes on while values lie beyond a line that starts at the
    row before with the slope of the ten before it; a minor one, looked for from the second
    walk on, is one row, filled from the left. A row is dealt with once; walks end with the
    first, but the second at the earliest, that finds nothing.
    """
    n, out, kept = len(v), v.astype(float).copy(), v.astype(float).copy()
    peaks: dict[int, float] = {}
    places = np.arange(10) - 4.5
    is_major, is_minor, settled = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    walk = 0
    while True:
        walk, found = walk + 1, False
        for i in range(11, n):
            jump = out[i] - out[i - 1]
            if settled[i] or abs(jump) <= 5:
                continue
            if i not in peaks:
                peaks[i] = local_peak(v, i)
            peak = peaks[i]
            scale, off, hi = log(peak) + 1e-4, abs(out[i] - (out[i - 3] + out[i - 2] + out[i - 1]) / 3), i
            if peak > 15 and off > 0 and log(off) / scale >= major:
                sign, slope = np.sign(jump), abs(float(places @ out[i - 10 : i])) / 82.5
                while hi < n and sign * (out[hi] - out[i - 1]) > slope * (hi - i) + 0.05:
                    hi += 1
                side = "left" if hours[-1] - hours[i] < 1 else "both"
                is_major[i:hi] = True
            elif walk > 1 and peak > 5 and log(abs(jump)) / scale >= minor and log(abs(jump)) / (log(local_peak(kept, i)) + 1) > 0.35:
                hi, side = i + 1, "left"
                is_minor[i] = True
            if hi == i:
                continue
            found, settled[i:hi], kept[i:hi] = True, True, np.nan
            before, after = rows_beside(i, hi, n, share)
            rows = before if side == "left" else np.concatenate([before, after])
            out[i:hi] = np.maximum(predicted(hours[rows], v[rows], hours[i:hi], "line"), 0.0) if hi - i < share * n else 0.0
        if walk > 1 and not found:
            return out, is_major, is_minor & ~is_major


def artifacts_removed(df: DataFrame, major: float = 0.8, minor: float = 0.5, keys: Sequence[str] = EPISODE) -> DataFrame:
    """tac without sudden jumps, and the flags major_outlier and minor_outlier. Sequential within an episode, so one group per episode."""

    def compute(rows: pa.Table):
        out, a, b = without_artifacts(np.nan_to_num(_numbers(rows, "tac")), _numbers(rows, "hours"), major, minor)
        return {"tac": np.maximum(out, 0.0), "major_outlier": a, "minor_outlier": b}

    return per_episode(df, {"tac": pa.float64(), "major_outlier": pa.int32(), "minor_outlier": pa.int32()}, compute, keys)


def bridged(v: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The values and the marks of `bridge_extremes` for one episode."""
    hit = v > cutoff
    if not hit.any() or len(v) <= 30 or v.max() - v.min() <= 5:
        return v, np.zeros(len(v), bool)
    known, at = np.flatnonzero(~hit), np.flatnonzero(hit)
    after = np.searchsorted(known, at)
    inside = (after > 0) & (after < len(known))
    out = v.copy()
    out[at[inside]] = (v[known[after[inside] - 1]] + v[known[after[inside]]]) / 2
    return out, hit


#: Columns that `repaired` adds: the value after each stage, and what marks the rows.
STAGES = {
    "tac_gaps_filled": pa.float64(), "tac_extremes": pa.float64(), "extreme_outlier": pa.int32(), "device_on": pa.int32(), "tac_device_off": pa.float64(),
    "device_off_imputed": pa.int32(), "tac_processed": pa.float64(), "major_outlier": pa.int32(), "minor_outlier": pa.int32(), "tac": pa.float64(),
}


def repaired(df: DataFrame, extreme: float = 800.0, wear_temp: float = 27.0, major: float = 0.8, minor: float = 0.5, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Gaps filled, extremes bridged, removal of the device filled and artifacts taken out, one after the other, in one pass over each episode.

    `df` has gap_imputed. The stages are those of `fill_missing`, `bridge_extremes`,
    `device_removal_filled` and `artifacts_removed`; the episode's values go from one to the
    next without leaving the task.
    """

    def compute(rows: pa.Table):
        hours, temp = _numbers(rows, "hours"), _numbers(rows, "temp")
        gaps = filled_where(_numbers(rows, "tac"), hours, _numbers(rows, "gap_imputed") == 1, limit=0.7, method="matern")
        extremes, marked = bridged(gaps, extreme)
        worn_ = np.isfinite(temp)
        off = filled_where(extremes, hours, worn_ & (temp <= wear_temp), extend=15, limit=0.9, side="flex", method="matern")
        out, a, b = without_artifacts(np.nan_to_num(off), hours, major, minor)
        out = np.maximum(out, 0.0)
        on = pa.array(temp > wear_temp, pa.bool_(), mask=~worn_).cast(pa.int32())
        return {
            "tac_gaps_filled": gaps, "tac_extremes": extremes, "extreme_outlier": marked, "device_on": on, "tac_device_off": off,
            "device_off_imputed": off != extremes, "tac_processed": out, "major_outlier": a, "minor_outlier": b, "tac": out,
        }

    return per_episode(df, STAGES, compute, keys)
