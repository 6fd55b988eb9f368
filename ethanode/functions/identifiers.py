"""Identifiers in file names and metadata, and labels derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subid_of(name: Column) -> Column:
    """The three to six digits at the start of a file name, else null."""
    found = F.regexp_extract(name, r"^(\d{3,6})", 1)
    return F.when(found != "", found)


def dataset_of(name: Column) -> Column:
    """The second `_` token of the name before its first dot, if it is three digits and not 000."""
    token = F.get(F.split(F.substring_index(name, ".", 1), "_"), F.lit(1))
    return F.when(token.rlike(r"^\d{3}$") & (token != "000"), token)


def extra_text_of(name: Column) -> Column:
    """The first three characters of the third `_` token, if there is one."""
    return F.substring(F.get(F.split(F.substring_index(name, ".", 1), "_"), F.lit(2)), 1, 3)


def extension_of(name: Column) -> Column:
    found = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(found != "", found)


def slice_positions(name: Column) -> Column:
    """First and last positions, from 0, of subid and dataset in a name like `1001_002_...`; null without a subid."""
    n = F.length(subid_of(name))
    return F.when(n.isNotNull(), F.array(F.lit(0), n - 1, n + 1, n + 3))


def sliced(name: Column, positions: Column) -> Column:
    """A struct of subid and dataset, cut from a name at the positions taken from another one."""
    cut = lambda i: F.substring(name, positions[i] + 1, positions[i + 1] - positions[i] + 1)
    return F.struct(cut(0).alias("subid"), cut(2).alias("dataset_identifier"))


def follows_convention(name: Column) -> Column:
    return subid_of(name).isNotNull() & dataset_of(name).isNotNull()


def condition_in_name(name: Column) -> Column:
    return F.when(name.contains("Alc"), "Alc").when(name.contains("Non"), "Non").otherwise("Unk")


def padded_dataset(ds: Column) -> Column:
    """Left-padded to three digits; longer ones stay whole."""
    text = ds.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def episode_label(episode: Column) -> Column:
    text = episode.cast("string")
    return F.when(text.startswith("e"), text).otherwise(F.concat(F.lit("e"), text))


def full_identifier(subid: Column, ds: Column, episode: Column) -> Column:
    return F.concat(subid.cast("string"), F.lit("_"), padded_dataset(ds), episode_label(episode))


def binge(drinks: Column, sex: Column) -> Column:
    """None, Unk, Heavy or Light, by the first test that fits."""
    return (
        F.when(drinks == 0, "None")
        .when(sex.isNull() | drinks.isNull(), "Unk")
        .when(((sex == 1) & (drinks >= 5)) | ((sex == 2) & (drinks >= 4)), "Heavy")
        .when(drinks > 0, "Light")
        .otherwise("Unk")
    )


def coerced_condition(c: Column) -> Column:
    return F.when(c.isin("Alc", "Non"), c).otherwise("Unk")


def nearest_odd(n: Column) -> Column:
    return 2 * F.bround(n / 2) + 1


def stable_six_digit_id(*cols: Column) -> Column:
    """A repeatable id of six digits whose first is not 0."""
    return (F.pmod(F.xxhash64(*cols), F.lit(900_000)) + 100_000).cast("string")
