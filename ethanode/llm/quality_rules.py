"""Quality rules per document, and verdicts on hosts from the rules' failures.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import WHITE_SPACE, materialize, words_column

SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules whose failures are counted by host: too short, repeated phrases, many signs, repeated lines, odd length of words.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "signs": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "words": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}


def _repeat_positions(placed: Column) -> Column:
    """Ascending 0-based places whose key is found twice or more, from (k, i) sorted by key."""
    marked = F.transform(placed, lambda x, j: F.struct(x["i"].alias("i"), ((F.get(placed, j - 1)["k"] == x["k"]) | (F.get(placed, j + 1)["k"] == x["k"])).alias("r")))
    return F.sort_array(F.transform(F.filter(marked, lambda x: x["r"]), lambda x: x["i"]))


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word); columns of these names are replaced.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none. n_repeat_words counts the words in
    3-word windows that the text holds twice or more. The work on a text is a sort of its
    windows, so it stays near its length however often windows repeat.
    """
    columns = [c for c in df.columns if c not in STATISTICS]
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE_SPACE, "")) > 0)
    df = df.withColumns({"__words": words_column(F.col(text_col)), "__lines": lines})
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(text, WHITE_SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "__keys": F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))),
    })
    df = df.withColumn("__keys", F.when(F.size("__words") > 3, F.col("__keys")))
    repeats = F.size(F.array_distinct("__keys")) < F.size("__keys")
    placed = F.sort_array(F.transform("__keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(repeats, placed))  # a column of its own: the lambdas below read it for every place
    df = df.withColumn("__places", _repeat_positions(F.col("__placed")))
    covered = F.aggregate(F.transform("__places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__places", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(*columns, *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def beta_prior(m: float | None, v: float | None) -> tuple[float, float]:
    """Parameters of a beta prior for rates of mean m and variance v, by the method of moments.

    Without spread between at least two hosts, or with a spread that no beta distribution
    has, it is the mean's share of two documents; without hosts, one of each.
    """
    if m is None:
        return 1.0, 1.0
    size = m * (1 - m) / v - 1 if v else 0.0
    size = size if size > 0 else 2.0
    return max(m * size, 1e-6), max((1 - m) * size, 1e-6)


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_host_rate: float = 0.5) -> DataFrame:
    """(id, host, the statistics, base_failed, host_failures, kept) for each row.

    Each rule of RULES has a failure rate in each host, shrunk with an empirical beta prior
    over the hosts, which weigh the same; host_failures lists the rules whose shrunken rate
    exceeds `max_host_rate` there. A row is kept unless it fails itself or its host has such a
    rule. Rows without a host are judged by themselves (host_failures is empty). Repeated rows
    each count and each come out; other columns of `df` are not read.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    stats = materialize(base_statistics(rows, "__text").drop("__text").withColumn("base_failed", base_failed()), "statistics")
    failures = [F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()]
    hosts = materialize(stats.where("__host is not null").groupBy("__host").agg(F.count(F.lit(1)).alias("n_docs"), *failures), "hosts")
    spread = hosts.agg(*[f(F.col(name) / F.col("n_docs")).alias(f"{k}_{name}") for name in RULES for k, f in (("m", F.avg), ("v", F.var_samp))]).first()
    bad = []
    for name in RULES:
        a, b = beta_prior(spread[f"m_{name}"], spread[f"v_{name}"])
        bad.append(F.when((F.col(name) + a) / (F.col("n_docs") + (a + b)) > max_host_rate, F.lit(name)))
    verdicts = hosts.select("__host", F.array_compact(F.array(*bad)).alias("host_failures"))
    out = stats.join(verdicts, "__host", "left").withColumn("host_failures", F.coalesce("host_failures", F.array().cast("array<string>")))
    kept = ~F.col("base_failed") & (F.size("host_failures") == 0)
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias(host_col), *STATISTICS, "base_failed", "host_failures", kept.alias("kept"))
