"""Proportional stratified interleaving of rows into shards.

Native: DataFrame functions only. Rows are shuffled within each stratum by a seeded hash;
a row's rank over its stratum's size is its fractional rank; in the order of fractional
ranks every stretch holds the strata in proportion, so cutting it into equal counts gives
shards that all match the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethanode.llm.common import materialize

#: Rows that one task ranks at a time, about.
RANK_ROWS = 100_000
_HASHES = 1 << 32


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A hash in [0, 2**32)."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(_HASHES))


def _ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """`rows` with `name`, the rank from 0 within `keys`; `bucket` rises with the order, so each bucket is ranked on its own and starts where the ones before it end."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    ranked = rows.withColumn("__own", own)
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return ranked.join(starts, same).withColumn(name, F.col("__own") + F.col("__start")).drop("__own", "__start", "__bucket", "__b", *[f"__{k}" for k in keys])


def interleave(df: DataFrame, shards: int = 24, id_col: str = "doc_id", stratum_col: str = "source", seed: int = 17) -> DataFrame:
    """`df` with shard (from 0) and slot (gapless from 0 in each shard); columns of these names are replaced.

    Shards' row counts differ by one at most, and so, give or take two rows, do the counts of
    each stratum. Fractional ranks of a stratum start at an offset hashed from its name, so
    that many small strata spread over all shards. Rows without a stratum are one of their
    own. The shuffle hashes a row's id and its place in the input, so that rows with one id,
    or with none, spread like all others; rows of one hash and one id are in no stated order.
    An empty table gives an empty table.
    """
    df = df.drop("shard", "slot")
    total = df.count()
    strata = df.groupBy(F.col(stratum_col).alias("__stratum")).agg(F.count(F.lit(1)).alias("__size"))
    rows = df.withColumns({"__stratum": F.col(stratum_col), "__hash": seeded_hash(seed, F.col(id_col), F.monotonically_increasing_id())})
    sized = materialize(rows.join(F.broadcast(strata) if strata.limit(10_001).count() <= 10_000 else strata, rows["__stratum"].eqNullSafe(strata["__stratum"])).drop(strata["__stratum"]), "sized")
    buckets = F.greatest(F.ceil(F.col("__size") / RANK_ROWS), F.lit(1))
    ranked = _ranked(sized, ["__stratum"], F.floor(F.col("__hash") * buckets / F.lit(float(_HASHES))), [F.col("__hash"), F.col(id_col)], "__rank")
    ranked = materialize(ranked.withColumn("__fraction", (F.col("__rank") + seeded_hash(seed, F.col("__stratum")) / F.lit(float(_HASHES))) / F.col("__size")), "ranked")
    parts = max(1, -(-total // RANK_ROWS))
    order = [F.col("__fraction"), F.col("__hash"), F.col(id_col)]
    placed = _ranked(ranked.withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col("__fraction") * parts), order, "__place")
    base, longer = divmod(total, shards)
    cut = longer * (base + 1)
    early = F.col("__place") < cut
    shard = F.when(early, F.floor(F.col("__place") / (base + 1))).otherwise(longer + F.floor((F.col("__place") - cut) / max(base, 1)))
    slot = F.when(early, F.pmod("__place", F.lit(base + 1))).otherwise(F.pmod(F.col("__place") - cut, F.lit(max(base, 1))))
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).select(*df.columns, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows in slot order within each of its files."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes, none for null, plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
