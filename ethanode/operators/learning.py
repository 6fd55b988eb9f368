"""Models over episode features: forests, logistic and linear regression, components, clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethanode.operators import windows
from ethanode.operators.cleaning import knee
from ethanode.operators.joins import excluded_and_kept, stacked
from ethanode.scratch import materialize

#: Folds whose predictions are written together.
FOLDS_WRITTEN = 32

#: Study designs by name: filters on features, the outcome's column and its labels.
DESIGNS = {
    "AlcNon": {"filters": {"condition": ["Unk"]}, "truth": "condition", "labels": {"Non": 0.0, "Alc": 1.0}},
    "Binge": {"filters": {"binge": ["Unk", "None"]}, "truth": "binge", "labels": {"Light": 0.0, "Heavy": 1.0}},
    "AUD": {"filters": {"condition": ["Non", "Unk"]}, "truth": "aud", "labels": {0: 0.0, 1: 1.0}},
    "worn": {"filters": {"device_on_label": ["unk"]}, "truth": "device_on_label", "labels": {0: 0.0, 1: 1.0}},
}

#: Outcomes as models are named after them (`RF_Binge`), and their designs.
OUTCOMES = {"Alc_vs_Non": "AlcNon", "Binge": "Binge", "AUD": "AUD"}
#: Features that are estimated where a curve is cut off, and what from.
ESTIMATED = {
    "fall_rate": ("relative_peak", "rise_duration", "rise_rate"),
    "fall_duration": ("relative_peak", "rise_duration", "rise_rate"),
    "rise_rate": ("relative_peak", "fall_duration", "fall_rate"),
    "rise_duration": ("relative_peak", "fall_duration", "fall_rate"),
}


def complete(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether all the columns have a value in a row, NaN not being one."""
    ok: Column = F.lit(True)
    for c in columns:
        number = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        ok = ok & F.col(c).isNotNull() & (~F.isnan(c) if number else F.lit(True))
    return ok


def assembled(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Rows with features; those without a value in every predictor are left out."""
    return VectorAssembler(inputCols=list(predictors), outputCol="features", handleInvalid="skip").transform(df)


def subject_folds(df: DataFrame, subject: str = "subid", folds: int | None = None) -> tuple[DataFrame, int]:
    """`df` with fold: one per subject, or subjects dealt over `folds` of them."""
    subjects = df.select(subject).distinct()
    n = subjects.count()
    if folds is None or folds >= n:
        # one model is fitted for each subject of a study, so they are few enough to be numbered in one window
        placed = subjects.withColumn("fold", (F.row_number().over(Window.orderBy(subject)) - 1).cast("int"))
        return df.join(placed, df[subject].eqNullSafe(placed[subject])).drop(placed[subject]), n
    return df.withColumn("fold", F.pmod(F.xxhash64(subject), F.lit(folds)).cast("int")), folds


def grid(kind: str, rows: int, small: bool = False):
    """(estimator, parameter maps) for `RF`, `LR` or `LinearReg`; small: one candidate per axis for quick runs.

    Depths run from 10 in steps of 4 up to 30, the deepest that Spark's forests have.
    """
    builder = ParamGridBuilder()
    if "RF" in kind:
        rf = RandomForestClassifier(seed=42)
        trees, features, depths = ([20], ["3"], [5]) if small else ([10, 50, 100, 300], ["3", "5"], [10, 14, 18, 22, 26, 30])
        return rf, builder.addGrid(rf.numTrees, trees).addGrid(rf.featureSubsetStrategy, features).addGrid(rf.maxDepth, depths).build()
    if "LinearReg" in kind:
        lin = LinearRegression()
        return lin, builder.addGrid(lin.fitIntercept, [True] if small else [True, False]).build()
    lr = LogisticRegression(standardization=False)
    cs = [1.0] if small else [10.0**k for k in range(-3, 4)]
    return lr, builder.addGrid(lr.regParam, [1 / (c * max(rows, 1)) for c in cs]).addGrid(lr.elasticNetParam, [0.0] if small else [0.0, 1.0]).build()


def optimized(df: DataFrame, kind: str, predictors: Sequence[str], label: str = "label", folds: int | None = None, small: bool = False):
    """The best model of the grid by cross-validation over subjects, and its table of results."""
    rows, n = subject_folds(assembled(df, predictors), folds=folds)
    rows = rows.withColumn("label", F.col(label).cast("double")).persist()
    try:
        estimator, maps = grid(kind, rows.count(), small)
        judge = RegressionEvaluator(metricName="mse") if "LinearReg" in kind else MulticlassClassificationEvaluator(metricName="accuracy")
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=judge, numFolds=max(2, n), foldCol="fold", parallelism=4).fit(rows)
    finally:
        rows.unpersist()
    return cv.bestModel, [({p.name: v for p, v in m.items()}, float(x)) for m, x in zip(maps, cv.avgMetrics, strict=True)]


def cross_validated(df: DataFrame, estimator, predictors: Sequence[str], label: str = "label", folds: int | None = None) -> DataFrame:
    """`df` with fold, predicted and probability for every row, each from a model that has not seen its subject; null where a predictor has no value."""
    rows, n = subject_folds(assembled(df, predictors), folds=folds)
    rows = rows.withColumn("label", F.col(label).cast("double")).persist()
    parts = []
    try:
        for fold in range(n):
            part = estimator.fit(rows.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold))
            parts.append(part.select(*df.columns, "fold", F.col("prediction").alias("predicted"), vector_to_array("probability")[1].alias("probability")))
        # a table for every few folds, so that the plan does not grow with them
        written = [materialize(stacked(*parts[i : i + FOLDS_WRITTEN]), "folds") for i in range(0, n, FOLDS_WRITTEN)]
    finally:
        rows.unpersist()
    lost = df.where(~complete(df, predictors)).withColumns({"fold": F.lit(None).cast("int"), "predicted": F.lit(None).cast("double"), "probability": F.lit(None).cast("double")})
    return stacked(lost, *written)


def area_under_roc(scored: DataFrame, probability: str = "probability", label: str = "label", buckets: int = 1024) -> DataFrame:
    """(auc) in one row: the share of pairs of label 1 and 0 that the scores order rightly, ties counting half; null without both labels.

    Rows are counted by score first, so that a score that many rows share is one row; scores
    are then ranked within buckets of their range, and between buckets by the buckets' counts.
    Rows without a label or a score, and NaN, do not count.
    """
    p, y = F.col(probability).cast("double"), F.col(label).cast("double")
    known = scored.where(p.isNotNull() & ~F.isnan(p) & y.isin(0.0, 1.0))
    counts = known.groupBy(p.alias("p")).agg(F.sum((y == 1).cast("long")).alias("ones"), F.sum((y == 0).cast("long")).alias("zeros"))
    counts = counts.withColumn("bucket", F.floor(F.greatest(F.least("p", F.lit(1.0)), F.lit(0.0)) * buckets).cast("int"))
    own = F.coalesce(F.sum("zeros").over(Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.withColumn("__lower", own).groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum(F.col("ones") * (F.col("__lower") + F.col("zeros") / 2)).alias("pairs"))
    rows = F.array_sort(F.collect_list(F.struct("bucket", "ones", "zeros", "pairs")))  # one for each bucket
    start = F.struct(F.lit(0).cast("long").alias("ones"), F.lit(0).cast("long").alias("zeros"), F.lit(0.0).alias("pairs"))
    walked = F.aggregate(rows, start, lambda t, x: F.struct((t["ones"] + x["ones"]).alias("ones"), (t["zeros"] + x["zeros"]).alias("zeros"), (t["pairs"] + x["pairs"] + x["ones"] * t["zeros"]).alias("pairs")))
    total = inside.agg(walked.alias("t"))
    return total.select(F.try_divide(F.col("t.pairs"), F.col("t.ones").cast("double") * F.col("t.zeros")).alias("auc"))


def roc_auc(scored: DataFrame, probability: str = "probability", label: str = "label") -> float | None:
    return area_under_roc(scored, probability, label).first()["auc"]


def outcome_kind(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """outcome (TP, FP, TN, FN) and result (correct, incorrect)."""
    t, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    kind = F.when((t == 1) & (p == 1), "TP").when((t == 0) & (p == 1), "FP").when((t == 0) & (p == 0), "TN").when((t == 1) & (p == 0), "FN")
    return df.withColumns({"outcome": kind, "result": F.when(t == p, "correct").otherwise("incorrect")})


def holdout(df: DataFrame, group: str = "subid", order: str = "row_id", share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(training, held out): the first round(n * share) groups in order of appearance are held out."""
    seen = df.groupBy(group).agg(F.min(order).alias("__first"))
    n = round(seen.count() * share)
    held = seen.orderBy("__first").limit(n).select(group)
    return df.join(held, group, "left_anti"), df.join(held, group, "left_semi")


def feature_estimators(features: DataFrame, wanted: Mapping[str, Sequence[str]] = ESTIMATED, suffix: str = "") -> dict[str, PipelineModel]:
    """A linear regression for each feature of `wanted` on its predictors, from the rows that have all of them; its column is predicted_<feature>."""
    out = {}
    for name, predictors in wanted.items():
        inputs, y = [f"{p}{suffix}" for p in predictors], f"{name}{suffix}"
        stages = [VectorAssembler(inputCols=inputs, outputCol="__x", handleInvalid="keep"), LinearRegression(featuresCol="__x", labelCol=y, predictionCol=f"predicted_{name}")]
        out[name] = Pipeline(stages=stages).fit(features.where(complete(features, [*inputs, y])))
    return out


def estimated(features: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """`features` with predicted_<feature> for each model, null where a predictor has no value."""
    for name, model in models.items():
        column = f"predicted_{name}"
        features = model.transform(features).drop("__x").withColumn(column, F.when(~F.isnan(column), F.col(column)))
    return features


def model_names(chosen: Mapping[str, Sequence[str]]) -> list[str]:
    """Names of the models to train, in order of outcomes: {"RF": ["Binge"]} has RF_Binge."""
    return [f"{kind}_{outcome}" for outcome in OUTCOMES for kind, outcomes in chosen.items() if outcome in outcomes]


def trained(features: DataFrame, names: Sequence[str], predictors: Sequence[str], folds: int | None = None, small: bool = False) -> dict[str, tuple]:
    """For each name, such as `RF_Binge`: (the model of the best settings, the table of the search, rows with fold, predicted, probability, outcome and result).

    Rows that the outcome's design excludes, or that have no label, follow with nulls. An
    outcome without a design is an error.
    """
    out = {}
    for name in names:
        kind, _, outcome = name.partition("_")
        design = DESIGNS[OUTCOMES[outcome]]
        kept, excluded = excluded_and_kept(features, design["filters"])
        labels = F.create_map(*[F.lit(x) for pair in design["labels"].items() for x in pair])
        rows = kept.withColumn("label", labels[F.col(design["truth"])])
        labelled = rows.where("label is not null")
        model, found = optimized(labelled, kind, predictors, folds=folds, small=small)
        estimator, maps = grid(kind, labelled.where(complete(labelled, predictors)).count(), small)
        best = max(range(len(maps)), key=lambda i: found[i][1])
        scored = outcome_kind(cross_validated(labelled, estimator.copy(maps[best]), predictors, folds=folds), "label")
        rest = rows.where("label is null").unionByName(excluded, allowMissingColumns=True)
        out[name] = (model, found, scored.unionByName(rest, allowMissingColumns=True))
    return out


def wear_model(df: DataFrame, predictors: Sequence[str], estimator, label: str = "device_on_label", ends: int = 10, share: float = 0.3, group: str = "episode", order: str = "event_id", keys: Sequence[str] = windows.EPISODE):
    """(model, rows with part, predicted and probability): whether a device was worn, learned from labelled rows.

    The first and last `ends` rows of an episode are left out (part `ends`), as are rows
    without a label (`unlabelled`) and without a value in every predictor (`incomplete`); of
    the rest, a `share` of groups is held out (`held`), the model is fitted to the others
    (`train`), and both get predictions. The rows are written once: a fit goes over its rows
    several times, and each time would make their features anew.
    """
    last = F.count(F.lit(1)).over(windows.whole(keys))
    df = materialize(df.withColumn("__inner", (F.col("idx") >= ends) & (F.col("idx") < last - ends)), "wear")
    inner, outer = df.where("__inner").drop("__inner"), df.where("not __inner").drop("__inner")
    ready = complete(df, predictors)
    known = inner.where(F.col(label).isNotNull() & ready)
    train, held = holdout(known, group, order, share)
    model = estimator.setLabelCol("__label").fit(assembled(train, predictors).withColumn("__label", F.col(label).cast("double")))
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held")))
    scored = model.transform(assembled(both, predictors)).select(*both.columns, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("probability"))
    lost = inner.where(F.col(label).isNull() | ~ready).withColumn("part", F.when(F.col(label).isNull(), "unlabelled").otherwise("incomplete"))
    return model, scored.unionByName(lost, allowMissingColumns=True).unionByName(outer.withColumn("part", F.lit("ends")), allowMissingColumns=True)


def explained_variance(df: DataFrame, predictors: Sequence[str], k: int) -> list[float]:
    """Shares of variance of the first k principal components, unscaled."""
    return [float(x) for x in PCA(k=k, inputCol="features", outputCol="__pc").fit(assembled(df, predictors)).explainedVariance.toArray()]


def importances(model, predictors: Sequence[str]) -> list[tuple[str, float]]:
    found = zip(predictors, model.featureImportances.toArray(), strict=True)
    return sorted(((n, float(x)) for n, x in found), key=lambda x: -x[1])


def distortions(df: DataFrame, predictors: Sequence[str], most: int = 9, seed: int = 42) -> list[float]:
    """Within-cluster sums of squares for k = 1..most; k = 1 is the total."""
    rows = assembled(df, predictors).persist()
    try:
        spread = rows.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).first()["s"]
        total = sum(spread["variance"]) * (spread["count"] - 1)
        return [float(total)] + [float(KMeans(k=k, seed=seed).fit(rows).summary.trainingCost) for k in range(2, most + 1)]
    finally:
        rows.unpersist()


def clustered(df: DataFrame, predictors: Sequence[str], most: int = 9, seed: int = 42) -> DataFrame:
    """`df` with cluster, for the number of clusters at the knee; null where a predictor has no value."""
    k = knee(distortions(df, predictors, most, seed))
    rows, lost = assembled(df, predictors), df.where(~complete(df, predictors)).withColumn("cluster", F.lit(None).cast("int"))
    found = rows.withColumn("cluster", F.lit(0)) if k < 2 else KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows)
    return found.drop("features").unionByName(lost)


def binary_predictions(features: DataFrame, model, predictors: Sequence[str], filters: dict, truth: str, labels: dict) -> DataFrame:
    """Predictions with label names and results for kept rows; the excluded rows follow with nulls."""
    kept, excluded = excluded_and_kept(features, filters)
    names = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (v, str(k))])
    out = model.transform(assembled(kept, predictors)).select(*features.columns, names[F.col("prediction")].alias("predicted"))
    out = out.withColumn("result", F.when(F.col("predicted") == F.col(truth).cast("string"), "correct").otherwise("incorrect"))
    return out.unionByName(excluded, allowMissingColumns=True)


def default_predictions(features: DataFrame, models: dict, predictors: Sequence[str]) -> DataFrame:
    """Condition, then binge for the episodes not predicted Non, from models by design name.

    Adds predicted_AlcNon and predicted_Binge (each only where its model is given), null for
    episodes that a design's filters exclude.
    """
    out = features
    for name in ("AlcNon", "Binge"):
        if name not in models:
            continue
        design = DESIGNS[name]
        rows = out if name == "AlcNon" or "AlcNon" not in models else out.where(F.coalesce("predicted_AlcNon", F.lit("")) != "Non")
        rest = None if rows is out else out.where(F.coalesce("predicted_AlcNon", F.lit("")) == "Non")
        got = binary_predictions(rows, models[name], predictors, design["filters"], design["truth"], design["labels"]).withColumnRenamed("predicted", f"predicted_{name}").drop("result")
        out = got if rest is None else got.unionByName(rest, allowMissingColumns=True)
    return out


def outcome_text(predicted: str, probability: str):
    """A sentence for one prediction and its probability."""
    return F.format_string("Predicted %s with probability %.2f", F.col(predicted), F.col(probability))


def binary_columns(metadata: DataFrame) -> list[str]:
    """Columns with exactly two values, which may serve as outcomes."""
    counts = metadata.agg(*[F.count_distinct(c).alias(c) for c in metadata.columns]).first()
    return [c for c in metadata.columns if counts[c] == 2]


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
