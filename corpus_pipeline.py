"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethanode.llm import decontaminate, language_id, near_dedup, packing, secrets
from ethanode.llm.common import bounded_batches, materialize, table

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is told; the models and bounds are learned from rows with a `lang`.

    Each row is judged by its own text, so rows without an id, or that share one, are like all
    others and repeated rows fare alike. Null and empty texts and those without letters go, and
    so do texts of `FIT_WORDS` distinct words or more whose words are far less likely in their
    best language than those of its labelled texts (`language_id.least_fits`). Where no row has
    a `lang` there is nothing to judge by, and all rows stay.
    """
    bounded_batches(spark)
    langs, model = language_id.train(docs)
    if not langs:
        return docs
    judged = language_id.identify(docs.withColumn("__row", F.struct(*docs.columns)), langs, model, columns=["__row"], fits=True)
    found = materialize(judged, "judged", "zstd")  # the bounds come from all of it, so each text is scored once
    least = language_id.least_fits(found, "__row.lang")
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("lang_pred")] if least else F.lit(None)
    alien = (F.col("distinct_words") >= language_id.FIT_WORDS) & F.coalesce(F.col("fit") < bound, F.lit(False))
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~alien).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, repeated rows and rows without an id included; null and empty texts are in no group."""
    bounded_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that contain no test item, each judged by its own text; null and empty texts and ids stay."""
    bounded_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced in their texts and n_chars, where there is one, counted anew; null texts stay null."""
    bounded_batches(spark)
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences; null texts count as empty."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models, MinHash and a tokenizer: tests compare the rows with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
