"""Quality classifier: a sparse ensemble of rules.

Shallow trees over text statistics give conjunctive rules (their paths); a lasso logistic
model weighs them; the rules that keep a weight become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import words_column
from ethanode.llm.quality_rules import base_statistics

FEATURES = ("words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "distinct_ratio", "bang_ratio", "pipe_ratio", "same_next_ratio", "mean_line", "long_ratio")


#: The bounded training rows are fitted in so many partitions: each step of a fit is a job, and up to four are summed in one stage.
FIT_PARTITIONS = 4


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_most, threshold) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.terms:
            out = out & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
        return out


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the features, which replace columns of their names; 0 throughout for null and wordless texts."""
    columns = [c for c in df.columns if c not in FEATURES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = base_statistics(df.withColumn("__t", text), text_col)
    words = words_column(F.col("__t"))
    df = df.withColumn("__w", words)

    def without(chars: str) -> Column:
        return F.length("__t") - F.length(F.translate("__t", chars, ""))

    n, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    lines = F.greatest(without("\n") + 1, F.lit(1)).cast("double")
    df = df.withColumns({
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_ratio": F.col("n_repeat_words") / n,
        "upper_ratio": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        "digit_ratio": without("0123456789") / chars,
        "punct_ratio": without(".,;:?'\"()") / n,
        "distinct_ratio": F.size(F.array_distinct("__w")) / n,
        "bang_ratio": without("!") / n,
        "pipe_ratio": without("|") / n,
        "same_next_ratio": F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("__w") - 1, F.lit(1))), lambda i: F.get("__w", i) == F.get("__w", i - 1))) / n,
        "mean_line": n / lines,
        "long_ratio": F.size(F.filter("__w", lambda w: F.length(w) > 20)) / n,
    })
    return df.select(*columns, *FEATURES)


def _paths(node, terms=()) -> list[tuple]:
    """The conjunctions of all nodes below a tree's node, inner ones included."""
    out = [terms] if terms else []
    if hasattr(node, "split") and node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = FEATURES[split.featureIndex()], split.threshold()
        out += _paths(node.leftChild(), (*terms, (name, True, threshold)))
        out += _paths(node.rightChild(), (*terms, (name, False, threshold)))
    return out


def fit_rules(labelled: DataFrame, label_col: str = "quality", trees: int = 20, depth: int = 3, lasso: float = 0.002, seed: int = 5) -> tuple[list[Rule], float]:
    """Rules with their weights, and the intercept, from rows with FEATURES and a 0/1 label."""
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = vector.transform(labelled.where(F.col(label_col).isin(0, 1)).withColumn("label", F.col(label_col).cast("double")))
    rows = rows.repartition(FIT_PARTITIONS).persist()
    try:
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
        n, ones = got["n"], got["ones"] or 0.0
        if n == 0 or ones in (0, n):
            return [], 0.0 if n == 0 else 5.0 if ones else -5.0
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(rows)
        found = sorted({p for t in forest._java_obj.trees() for p in _paths(t.rootNode())})
        rules = [Rule(p) for p in found]
        if not rules:
            return [], 5.0 if 2 * ones > n else -5.0
        flags = [f"r{i}" for i in range(len(rules))]
        held = rows.select("label", *[r.holds().cast("double").alias(f) for r, f in zip(rules, flags, strict=True)])
        design = VectorAssembler(inputCols=flags, outputCol="features").transform(held).select("features", "label").persist()
        try:
            model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(design)
        finally:
            design.unpersist()
    finally:
        rows.unpersist()
    weights = model.coefficients.toArray()
    return [Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9], float(model.intercept)


def score_column(rules: list[Rule], intercept: float) -> Column:
    """The probability of label 1, as one expression over the features."""
    total = F.lit(intercept)
    for r in rules:
        total = total + F.when(r.holds(), F.lit(r.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 8_000) -> DataFrame:
    """(id, score) for every document; score is the probability that its label is 1.

    `labels` has the ids and labels to learn from. The fit uses a bounded sample, about
    `train_rows` of them chosen by a hash of the id; labels that are null or not 0 or 1, and
    ids with both labels, are left out, repeated labels count once. Without labels the score is
    0.5; null and wordless texts get a score like all. Repeated rows each come out; other
    columns of `docs` are not read.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where(F.col("__label").isin(0, 1))
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most").drop("__most")
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_rows / max(n, 1))) + 1)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rules, intercept = fit_rules(statistics(rows.join(F.broadcast(chosen), "__id"), "__text"), "__label")
    return statistics(rows, "__text").select(F.col("__id").alias(id_col), score_column(rules, intercept).alias("score"))
