"""URL verdicts: host and path rules, and boosted trees on lexical features for the rest."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import ascii_lower, materialize

#: (rule, verdict): host, then the path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_seen")
ENTROPY_CHARS = string.ascii_lowercase + string.digits + "-._~:/?#[]@!$&'()*+,;=%"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and path; both empty without one or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, r"^([^?#]*)", 1)
    slash = F.instr(before, "/")
    host = F.when(slash > 0, F.substring(before, F.lit(1), slash - 1)).otherwise(before)
    path = F.when(slash > 0, F.substring(before, slash, F.length(before))).otherwise("")
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and the path's beginning."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests)


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.create_map(*[F.lit(x) for pair in rules for x in pair])[rule]


def parsed(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, url, host, path, rule, suffix): suffix is the host's last two labels."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    return rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "suffix": F.substring_index("host", ".", -2)})


def lexical(rows: DataFrame) -> DataFrame:
    """`rows` with the features that one url shows by itself."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")

    def count(chars: str) -> Column:
        return (F.length(url) - F.length(F.translate(url, chars, ""))).cast("double")

    low = ascii_lower(url)
    entropy = F.lit(0.0)
    for c in ENTROPY_CHARS:
        p = (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / n
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
        "host_labels": F.size(F.array_remove(F.split("host", r"\."), "")).cast("double"),
        "digit_ratio": count(string.digits) / n,
        "entropy": entropy,
        "parameters": F.size(F.array_remove(F.split(query, "&"), "")).cast("double"),
        "hyphens": count("-"),
    })


#: Labelled urls learn the statistics of suffixes from the other folds.
FOLDS = 5


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, fold, b, n), written: blocked and all labelled urls of a suffix; fold -1 has the sums of all folds.

    Written, so that a join on it shuffles both sides itself and a hot suffix can be split.
    """
    per = labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).cast("double").alias("n"))
    total = per.groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).withColumn("fold", F.lit(-1))
    return materialize(per.unionByName(total), "suffixes")


def with_suffix_statistics(rows: DataFrame, counts: DataFrame, own_fold: bool = False) -> DataFrame:
    """`rows` with suffix_rate (share of blocked urls, smoothed) and suffix_seen (log of the labelled ones).

    With `own_fold` a row's statistics are those of the folds other than its own, so that
    its own label has no part in them.
    """
    total = counts.where("fold = -1").select("suffix", F.col("b").alias("__b"), F.col("n").alias("__n"))
    rows = rows.join(total, "suffix", "left")
    b, n = F.coalesce("__b", F.lit(0.0)), F.coalesce("__n", F.lit(0.0))
    if own_fold:
        mine = counts.where("fold >= 0").select("suffix", "fold", F.col("b").alias("__ob"), F.col("n").alias("__on"))
        rows = rows.join(mine, ["suffix", "fold"], "left")
        b, n = b - F.coalesce("__ob", F.lit(0.0)), n - F.coalesce("__on", F.lit(0.0))
    return rows.withColumns({"suffix_rate": (b + 1) / (n + 2), "suffix_seen": F.log1p(n)})


def with_labels(rows: DataFrame, rules=RULES) -> DataFrame:
    """The rows of `parsed` that a rule fits, with label (1: block) and the fold of their url."""
    labelled = rows.where("rule is not null")
    return labelled.withColumns({"label": (verdict_of(F.col("rule"), rules) == "block").cast("double"), "fold": F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")})


def fit_trees(labelled: DataFrame, counts: DataFrame, share: float = 1.0, trees: int = 10, depth: int = 4, seed: int = 11) -> GBTClassificationModel:
    """Boosted trees on a `share` of the labelled rows, chosen by a hash of the url."""
    chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, share)) + 1
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sample = vector.transform(with_suffix_statistics(lexical(labelled.where(chosen)), counts, own_fold=True)).select("features", "label").persist()
    try:
        return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(sample)
    finally:
        sample.unpersist()


def scored(rows: DataFrame, model: GBTClassificationModel, counts: DataFrame) -> DataFrame:
    """`rows` with block_score, the trees' probability of `block`."""
    out = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffix_statistics(lexical(rows), counts)))
    return out.withColumn("block_score", vector_to_array("probability")[1])


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 11) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) for each row.

    Labelled urls are those that a rule fits. Statistics of suffixes (share of blocked ones,
    smoothed, and the log of the number labelled) cover all of them, for a labelled url those
    of the other folds; the trees are fitted on at most about `train_rows`, chosen by a hash
    of the url. A url that no rule fits, null ones included, gets `block` where the trees give
    it a probability over one half. If the labelled urls show one verdict only, the rest get
    that one; if there are none, `allow`. Repeated rows each come out; other columns of `df`
    are not read.
    """
    rows = parsed(df, id_col, url_col, rules)
    labelled = with_labels(rows, rules)
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = totals["n"], totals["blocked"] or 0.0
    own = verdict_of(F.col("rule"), rules)
    if n == 0 or blocked in (0, n):
        rest = F.lit("block" if n and blocked == n else "allow")
        out = rows.withColumns({"verdict": F.coalesce(own, rest), "block_score": F.lit(None).cast("double")})
        return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "block_score")
    counts = suffix_counts(labelled)
    model = fit_trees(labelled, counts, train_rows / n, trees, depth, seed)
    verdict = F.coalesce(own, F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored(rows, model, counts).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
