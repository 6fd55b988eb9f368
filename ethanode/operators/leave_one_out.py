"""Whole grids of linear and logistic models with every subject left out in turn.

A linear model needs sums of products only, so one aggregation gives those of each subject,
and a fold's are the total's without its own. Logistic fits of all (subject, setting) pairs are
read off the model of all rows, its derivatives and the subject's own, within a proven bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ethanode.operators.learning import assembled, complete
from ethanode.scratch import materialize

#: The logistic grid: inverse penalties and their kinds.
INVERSE_PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
PENALTIES = ("l1", "l2")
#: Numbers of a table of rows that every task may hold: 32 MB.
HELD_CELLS = 4_000_000


def _sums(columns: Sequence[Column]) -> Column:
    """The sums of products of all pairs, row by row of the triangle, as an array."""
    return F.array(*[F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]])


def _solved(moments: np.ndarray, p: int, intercept: bool) -> list[float]:
    """[constant, coefficients] of least squares from the triangle of products of (1, x, y); the shortest where columns depend on each other."""
    full = np.zeros((p + 2, p + 2))
    full[np.triu_indices(p + 2)] = moments
    full = full + np.triu(full, 1).T
    if intercept:
        n = full[0, 0]
        if n <= 0:
            return [float("nan")] * (p + 1)
        mean = full[0] / n
        full = full - np.outer(full[0], full[0]) / n
    used = slice(1, p + 1)
    scale = np.sqrt(np.maximum(np.diag(full)[used], 1e-300))
    b = np.linalg.lstsq(full[used, used] / np.outer(scale, scale), full[used, p + 1] / scale, rcond=1e-13)[0] / scale
    return [float(mean[p + 1] - mean[used] @ b) if intercept else 0.0, *map(float, b)]


def linear_folds(df: DataFrame, predictors: Sequence[str], label: str, subject: str = "subid") -> DataFrame:
    """(subject, intercept, coefficients): for each subject and setting, the model of all other subjects' rows; coefficients begin with the constant.

    Rows without a value in a predictor or the label are not learned from. A fold without
    other rows has NaN with an intercept and 0 without one.
    """
    p = len(predictors)
    rows = df.where(complete(df, [*predictors, label]))
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in predictors], F.col(label).cast("double")]
    own = materialize(rows.groupBy(F.col(subject).alias("__subject")).agg(_sums(columns).alias("own")), "moments")
    size = (p + 2) * (p + 3) // 2
    total = own.agg(F.array(*[F.sum(F.get("own", F.lit(i))) for i in range(size)]).alias("total"))
    everyone = df.select(F.col(subject).alias("__subject")).distinct()
    none = F.array_repeat(F.lit(0.0), size)
    held = everyone.join(own, everyone["__subject"].eqNullSafe(own["__subject"]), "left").select(everyone["__subject"].alias("subject"), F.coalesce("own", none).alias("own"), F.lit(1).alias("__one"))
    rest = held.join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one").select("subject", F.zip_with(F.coalesce("total", none), "own", lambda t, o: t - o).alias("rest"))

    def solve(batches):
        for batch in batches:
            moments = np.array(batch.column(1).to_pylist(), float).reshape(-1, size)
            for intercept in (True, False):
                found = [_solved(m, p, intercept) for m in moments]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([intercept] * len(found)), pa.array(found, pa.list_(pa.float64()))], names=["subject", "intercept", "coefficients"])

    kind = df.schema[subject].dataType.simpleString()
    return rest.mapInArrow(solve, f"subject {kind}, intercept boolean, coefficients array<double>")


def _fitted(predictors: Sequence[str]) -> Column:
    out = F.get("coefficients", F.lit(0))
    for i, c in enumerate(predictors, 1):
        out = out + F.get("coefficients", F.lit(i)) * F.col(c)
    return out


def linear_leave_one_out(df: DataFrame, predictors: Sequence[str], label: str, subject: str = "subid") -> DataFrame:
    """`df` twice, with intercept and predicted: each row by the models, with and without a constant, that have not seen its subject; null where a predictor has no value."""
    folds = linear_folds(df, predictors, label, subject)
    same = df[subject].eqNullSafe(folds["subject"])
    value = _fitted(predictors)
    return df.join(folds, same).withColumn("predicted", F.when(complete(df, predictors) & ~F.isnan(value), value)).drop("subject" if subject != "subject" else folds["subject"], "coefficients")


def linear_grid(df: DataFrame, predictors: Sequence[str], label: str, subject: str = "subid") -> DataFrame:
    """(intercept, squared_error): of both settings, the mean over subjects of their mean squared errors."""
    scored = linear_leave_one_out(df, predictors, label, subject)
    each = scored.groupBy("intercept", F.col(subject).alias("__subject")).agg(F.avg((F.col("predicted") - F.col(label)) ** 2).alias("e"))
    return each.groupBy("intercept").agg(F.avg("e").alias("squared_error"))


def logistic(x: np.ndarray, y: np.ndarray, l1: float, l2: float, steps: int = 100) -> np.ndarray:
    """[constant, coefficients] of least mean log loss plus l1 * sum |b| + l2 / 2 * sum b * b, the constant free of penalty.

    Newton steps on the columns centred and scaled: each minimises the quadratic around the
    current point with the penalties, coordinate by coordinate, and is halved until the loss falls.
    """
    if y.min(initial=1) == y.max(initial=0):  # one class: the constant alone, as far as it goes
        return np.concatenate([[50.0 if len(y) and y[0] else -50.0], np.zeros(x.shape[1])])
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - middle) / scale])
    first, second = np.concatenate([[0], l1 / scale]), np.concatenate([[0], l2 / scale**2])

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float(np.mean(np.logaddexp(0, m) - y * m) + first @ np.abs(b) + (second @ (b * b)) / 2)

    b = np.zeros(z.shape[1])
    b[0] = np.log(y.mean() / (1 - y.mean()))
    now = loss(b)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        slope = z.T @ (q - y) / len(y)
        bend = (z * np.maximum(q * (1 - q), 1e-9)[:, None]).T @ z / len(y)
        to = _penalised_step(b, slope, bend, first, second)
        size, moved = 1.0, False
        while size > 1e-8:
            trial = b + size * (to - b)
            value = loss(trial)
            if value <= now:
                moved = now - value > 1e-14 * max(1.0, abs(now))
                b, now = trial, value
                break
            size /= 2
        if not moved:
            break
    return np.concatenate([[b[0] - (b[1:] / scale) @ middle], b[1:] / scale])


def _penalised_step(b, slope, bend, first, second) -> np.ndarray:
    """Where the quadratic of this slope and bend, with the penalties, is least."""
    if not first.any():
        return b - np.linalg.solve(bend + np.diag(second + 1e-12), slope + second * b)
    to, linear = b.copy(), slope - bend @ b
    for _ in range(1000):
        most = 0.0
        for j in range(len(b)):
            pull = linear[j] + bend[j] @ to - bend[j, j] * to[j]
            new = -np.sign(pull) * max(abs(pull) - first[j], 0.0) / (bend[j, j] + second[j])
            most = max(most, abs(new - to[j]))
            to[j] = new
        if most < 1e-10:
            break
    return to


def _steps_together(b: np.ndarray, slope: np.ndarray, bend: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """`_penalised_step` of many models at once: b and slope models x columns, bend models x columns x columns."""
    diagonal = np.einsum("fii->fi", bend)
    if not first.any():
        return b - np.linalg.solve(bend + np.diag(second + 1e-12), (slope + second * b)[:, :, None])[:, :, 0]
    to, linear = b.copy(), slope - np.einsum("fij,fj->fi", bend, b)
    live = np.arange(len(b))
    for _ in range(1000):
        if not len(live):
            break
        most = np.zeros(len(live))
        for j in range(b.shape[1]):
            pull = linear[live, j] + np.einsum("fj,fj->f", bend[live, j], to[live]) - diagonal[live, j] * to[live, j]
            new = -np.sign(pull) * np.maximum(np.abs(pull) - first[j], 0.0) / (diagonal[live, j] + second[j])
            most = np.maximum(most, np.abs(new - to[live, j]))
            to[live, j] = new
        live = live[most >= 1e-12]
    return to


def _prepared(batch: pa.RecordBatch, middle: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether rows are learned from, 1 and the scaled predictors, labels) of (subject, y, predictors...); all 0 where they are not."""
    y = batch.column(1).to_numpy(zero_copy_only=False)
    used = np.isfinite(y)
    x = np.array([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(middle))], float).T.reshape(-1, len(middle))
    z = np.where(used[:, None], np.hstack([np.ones((len(x), 1)), (x - middle) / scale]), 0.0)
    return used, z, np.where(used, y, 0.0)


def _moments(z: np.ndarray, y: np.ndarray, used: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' probabilities and their first and second derivatives by the margin, 0 for rows not used."""
    q = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
    return (q - y) * used, q * (1 - q) * used, q * (1 - q) * (1 - 2 * q) * used


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most 1,000 rows at a time: a row's sums are some hundred numbers for each setting."""
    return (b.slice(at, 1_000) for b in batches for at in range(0, b.num_rows, 1_000))


def _summed(rows: DataFrame, width: int, per_batch) -> np.ndarray:
    """The sum over batches of `per_batch`, vectors of `width` numbers: each task sends one."""

    def each(batches):
        total = np.zeros(width)
        for batch in _parts(batches):
            total += per_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return np.sum([r["v"] for r in rows.mapInArrow(each, "v array<double>").collect()] or [np.zeros(width)], axis=0)


def _whole_fits(rows: DataFrame, n: int, penalties: Sequence[tuple[np.ndarray, np.ndarray]], middle: np.ndarray, scale: np.ndarray, start: float, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(models, their bends) over all rows, one for each pair of penalties: Newton steps whose sums one job makes for all of them."""
    k, d = len(penalties), len(middle) + 1
    now = np.full(k, np.inf)
    b = np.zeros((k, d))
    b[:, 0] = start
    trial, moving, size = b.copy(), np.ones(k, bool), np.ones(k)
    bends, to = np.zeros((k, d, d)), b.copy()
    for _ in range(steps):
        if not moving.any():
            break
        at = trial.copy()

        def sums(batch, at=at):
            used, z, y = _prepared(batch, middle, scale)
            out = []
            for point in at:
                m = z @ point
                first, second, _ = _moments(z, y, used, point)
                out.append(np.concatenate([[((np.logaddexp(0, m) - y * m) * used).sum()], z.T @ first, ((z * second[:, None]).T @ z).ravel()]))
            return np.concatenate(out)

        found = _summed(rows, k * (1 + d + d * d), sums).reshape(k, -1) / n
        for i, (first, second) in enumerate(penalties):
            if not moving[i]:
                continue
            value = found[i, 0] + first @ np.abs(trial[i]) + (second @ (trial[i] ** 2)) / 2
            if value <= now[i]:
                moving[i] = now[i] - value > 1e-14 * max(1.0, abs(value)) or np.isinf(now[i])
                b[i], now[i], size[i] = trial[i], value, 1.0
                bends[i] = found[i, 1 + d :].reshape(d, d)
                to[i] = _steps_together(b[i : i + 1], found[i : i + 1, 1 : 1 + d], bends[i : i + 1], first, second)[0]
            else:
                size[i] /= 2
                moving[i] = size[i] > 1e-8
            trial[i] = b[i] + size[i] * (to[i] - b[i])
    return b, bends


#: Error of a fold's model, in standard deviations of its margin, over which the fold is fitted by itself.
TOLERANCE = 1e-7


def logistic_leave_one_out(df: DataFrame, predictors: Sequence[str], label: str = "label", subject: str = "subid", inverse: Sequence[float] = INVERSE_PENALTIES, penalties: Sequence[str] = PENALTIES, held_cells: int = HELD_CELLS) -> DataFrame:
    """`df` once for each setting, with c, penalty, probability and predicted: each row by the model that has not seen its subject; null where a predictor has no value.

    Rows without a value in a predictor, or with a label that is not 0 or 1, are not learned from.

    Fitting every fold over all rows is the square of their number. The model of all rows is
    fitted instead; around it the loss of the others is a polynomial whose coefficients are the
    total's without the subject's own, and the fold's model is its least point. What the
    polynomial leaves out is bounded, and a fold for which that is over `TOLERANCE` (its
    subject has a notable share of the rows, so there are few) is fitted over all rows itself.
    """
    settings = list(product(inverse, penalties))
    ready, d = complete(df, predictors), len(predictors) + 1
    usable = ready & F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    narrow = df.select(F.col(subject).alias("subject"), F.when(usable, F.col(label).cast("double")).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)])
    rows = materialize(narrow.repartition("subject").sortWithinPartitions("subject"), "subjects")
    known = rows.where("y is not null")
    about = known.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(d - 1) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, ones = about["n"], about["ones"] or 0.0
    middle = np.array([about[f"m{i}"] or 0.0 for i in range(d - 1)])
    scale = np.array([about[f"s{i}"] or 1.0 for i in range(d - 1)])
    weights = [(1 / (c * max(n, 1)) * (kind == "l1"), 1 / (c * max(n, 1)) * (kind == "l2")) for c, kind in settings]
    scaled = [(np.concatenate([[0], l1 / scale]), np.concatenate([[0], l2 / scale**2])) for l1, l2 in weights]
    easy = 0 < ones < n
    if easy:
        whole, bends = _whole_fits(known, n, scaled, middle, scale, float(np.log(ones / (n - ones))))
        inverses = np.linalg.pinv(bends, hermitian=True)

        def thirds(batch):
            used, z, y = _prepared(batch, middle, scale)
            pairs = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
            out = []
            for b, inv in zip(whole, inverses, strict=True):
                first, second, third = _moments(z, y, used, b)
                far = np.einsum("ri,ij,rj->r", z, inv, z) ** 2
                out.append(np.concatenate([z.T @ first, ((z * second[:, None]).T @ z).ravel(), ((pairs * third[:, None]).T @ z).ravel(), [(far * used).sum()]]))
            return np.concatenate(out)

        width = d + d * d + d**3
        total = _summed(known, len(settings) * (width + 1), thirds).reshape(len(settings), -1)
        shared = df.sparkSession.sparkContext.broadcast((whole, bends, total))

    def solved(own: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(models, whether they are near enough) of the folds with these own sums (count, ones, then as in `total`)."""
        whole, bends, total = shared.value
        m = n - own[:, 0]
        one_class = (ones - own[:, 1] <= 0) | (ones - own[:, 1] >= m)
        rest = (total[i, :width] - own[:, 2:]) / np.maximum(m, 1)[:, None]
        slope0, bend0, third = rest[:, :d], rest[:, d : d + d * d].reshape(-1, d, d), rest[:, d + d * d :].reshape(-1, d, d, d)
        base, (first, second) = whole[i], scaled[i]
        b = np.repeat(base[None], len(own), axis=0)
        for _ in range(12):
            delta = b - base
            turn = np.einsum("fijk,fk->fij", third, delta)
            new = _steps_together(b, slope0 + np.einsum("fij,fj->fi", bend0 + turn / 2, delta), bend0 + turn, first, second)
            moved = np.abs(new - b).max(initial=0.0)
            b = new
            if not moved > 1e-11:
                break
        delta = b - base
        length = np.sqrt(np.maximum(np.einsum("fi,ij,fj->f", delta, bends[i], delta), 0.0))
        error = total[i, width] / 48 / np.maximum(m, 1) * length**3 * 2
        return b, (error <= TOLERANCE) & (own[:, 0] < n / 4) & ~one_class & np.isfinite(b).all(axis=1)

    def fold_models(batches):
        kept_subject, kept = None, None
        for batch in chain(_parts(batches), [None]):
            if batch is None:
                if kept is None:
                    return
                subjects, sums = [kept_subject], kept[:, None]
            else:
                if not batch.num_rows:
                    continue
                used, z, y = _prepared(batch, middle, scale)
                names = batch.column(0).to_pylist()
                starts = [0] + [r for r in range(1, len(names)) if names[r] != names[r - 1]]
                pairs = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                triples = (pairs[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                sums = []
                for b in shared.value[0]:
                    first, second, third = _moments(z, y, used, b)
                    each = np.hstack([used[:, None], y[:, None], z * first[:, None], pairs * second[:, None], triples * third[:, None]])
                    sums.append(np.add.reduceat(each, starts, axis=0))
                sums, subjects = np.array(sums), [names[r] for r in starts]
                if kept is not None:
                    if subjects[0] == kept_subject:
                        sums[:, 0] += kept
                    else:
                        sums, subjects = np.concatenate([kept[:, None], sums], axis=1), [kept_subject, *subjects]
                kept_subject, kept = subjects[-1], sums[:, -1].copy()
                subjects, sums = subjects[:-1], sums[:, :-1]
            for i, (c, kind) in enumerate(settings):
                if subjects:
                    b, near = solved(sums[i], i)
                    raw = np.hstack([b[:, :1] - (b[:, 1:] / scale) @ middle[:, None], b[:, 1:] / scale])
                    found = [r.tolist() if ok else None for r, ok in zip(raw, near, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(subjects, batch_type), pa.array([i] * len(subjects), pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["subject", "setting", "coefficients"])

    batch_type = to_arrow_type(df.schema[subject].dataType)
    shape = f"subject {df.schema[subject].dataType.simpleString()}, setting int, coefficients array<double>"
    placed = rows.repartition("subject").sortWithinPartitions("subject")
    if easy:
        found = materialize(placed.mapInArrow(fold_models, shape), "folds")
    else:
        every = rows.select("subject").distinct().withColumn("setting", F.explode(F.array(*[F.lit(i) for i in range(len(settings))])))
        found = materialize(every.withColumn("coefficients", F.lit(None).cast("array<double>")), "folds")
    hard = found.where("coefficients is null").select("subject", "setting")
    models = found.where("coefficients is not null").unionByName(_fits_apart(hard, known, n, d - 1, weights, held_cells, shape))
    kinds = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(kind).alias("penalty")) for c, kind in settings])
    models = models.withColumn("__kind", F.get(kinds, F.col("setting"))).select(F.col("subject").alias("__subject"), F.col("__kind.c").alias("c"), F.col("__kind.penalty").alias("penalty"), "coefficients")
    scored = df.join(models, df[subject].eqNullSafe(models["__subject"])).withColumn("probability", F.when(ready, 1 / (1 + F.exp(-_fitted(predictors)))))
    return scored.select(*df.columns, "c", "penalty", "probability", F.when(F.col("probability").isNotNull(), (F.col("probability") > 0.5).cast("double")).alias("predicted"))


def _fits_apart(hard: DataFrame, known: DataFrame, n: int, p: int, weights: Sequence[tuple[float, float]], held_cells: int, shape: str) -> DataFrame:
    """Models of these (subject, setting), each over all rows but the subject's, which a task holds up to `held_cells` numbers of; beyond that Spark's estimator fits them one by one."""
    spark = hard.sparkSession
    if n * (p + 2) > held_cells:
        out = []
        columns = [f"x{i}" for i in range(p)]
        for r in hard.toLocalIterator():
            rest = known.where(~F.col("subject").eqNullSafe(F.lit(r["subject"])))
            counts = rest.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
            if not 0 < (counts["ones"] or 0) < counts["n"]:
                out.append((r["subject"], r["setting"], [50.0 if counts["ones"] else -50.0, *[0.0] * p]))
                continue
            l1, l2 = weights[r["setting"]]
            model = LogisticRegression(labelCol="y", standardization=False, regParam=l1 + l2, elasticNetParam=float(l1 > 0), tol=1e-10, maxIter=500).fit(assembled(rest, columns))
            out.append((r["subject"], r["setting"], [float(model.intercept), *map(float, model.coefficients)]))
        return spark.createDataFrame(out, shape)
    held = known.toArrow()
    table = spark.sparkContext.broadcast((held["subject"].to_pylist(), np.array([held[f"x{i}"].to_numpy() for i in range(p)], float).T.reshape(-1, p), held["y"].to_numpy()))

    def fit(batches):
        names, x, y = table.value
        subjects = np.array(names, object)
        for batch in batches:
            found = []
            for who, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = np.not_equal(subjects, who)
                found.append(logistic(x[other], y[other], *weights[i]).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=["subject", "setting", "coefficients"])

    return materialize(hard.repartition(max(spark.sparkContext.defaultParallelism, 1), "subject", "setting").mapInArrow(fit, shape), "logistic")


def logistic_grid(df: DataFrame, predictors: Sequence[str], label: str = "label", subject: str = "subid", **how) -> DataFrame:
    """(c, penalty, accuracy): of each setting, the mean over subjects of the share of their rows that is told right."""
    scored = logistic_leave_one_out(df, predictors, label, subject, **how).where(F.col("predicted").isNotNull() & F.col(label).isin(0, 1))
    each = scored.groupBy("c", "penalty", F.col(subject).alias("__subject")).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a"))
    return each.groupBy("c", "penalty").agg(F.avg("a").alias("accuracy"))
