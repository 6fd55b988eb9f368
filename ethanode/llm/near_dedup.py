"""Near-duplicate groups by b-bit MinHash.

Texts that are equal word by word are one class. Each class keeps the low bits of its minima,
packed into words; bands of whole minima give buckets of candidates; the share of equal low
bits, corrected for chance collisions, estimates the similarity; pairs that pass are confirmed
on their full shingle sets. Within a bucket all members are first compared with its smallest
one. Members that this leaves in different components are then compared with each other inside
the bucket, and only links come out: the components are those of all pairs, but pairs inside a
component are never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import WordHashes, bucketed, discard, materialize, numbered, shingle_hashes
from ethanode.llm.components import connected_components

BITS = 4
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 4.0
#: Bytes of one side of a comparison within a bucket.
BLOCK_BYTES = 8_000_000


class Sketcher:
    """Shingle sets and signatures of texts."""

    def __init__(self, shingle: int, bands: int, rows: int, seed: int = 7):
        self.shingle, self.bands, self.rows, self.hashes = shingle, bands, rows, WordHashes()
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct 64-bit shingle hashes, ascending."""
        return np.unique(shingle_hashes(self.hashes.of(text.lower().split()), self.shingle))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(shingles), 1024):
            block = shingles[lo : lo + 1024, None] * self.mul + self.add
            np.minimum(out, (block >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> list[int]:
        raw = minima.astype("<u4").tobytes()
        width = 4 * self.rows
        return [xxhash.xxh3_64_intdigest(raw[b * width : (b + 1) * width], seed=b) - (1 << 63) for b in range(self.bands)]


def packed_bits(minima: np.ndarray, bits: int = BITS) -> bytes:
    """The low bits of all minima, side by side in 64-bit words."""
    per = 64 // bits
    low = np.zeros(-(-len(minima) // per) * per, np.uint64)
    low[: len(minima)] = minima & np.uint32((1 << bits) - 1)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(low.reshape(-1, per) << shifts, axis=1).astype("<u8").tobytes()


def estimates(left: np.ndarray, right: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """Similarity of packed signatures (rows of uint64, broadcast), from bit counts, corrected for the chance that unequal minima share their low bits."""
    diff = left ^ right
    for k in range(bits.bit_length() - 1):
        diff = diff | (diff >> np.uint64(1 << k))
    lowest = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    unequal = np.bitwise_count(diff & lowest).sum(axis=-1)
    chance = 2.0**-bits
    return (1 - unequal / n - chance) / (1 - chance)


def cutoff(threshold: float, n: int) -> float:
    p = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - SLACK * math.sqrt(p * (1 - p) / n) / (1 - 2.0**-BITS)


def sketches(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, doc, class_a, class_b, n_shingles, bits, bands) for each row of `texts` (id, text, doc); no class without words."""

    def sketch(batches):
        s = Sketcher(shingle, bands, rows)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                if not words:
                    out.append((None, None, 0, None, None))
                    continue
                got = np.unique(shingle_hashes(s.hashes.of(words), shingle))
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                a, b = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
                minima = s.minima(got)
                out.append((a, b, len(got), packed_bits(minima), s.band_keys(minima)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "doc", "class_a", "class_b", "n_shingles", "bits", "bands"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("id", "text", "doc").mapInArrow(sketch, f"id long, doc {kind}, class_a long, class_b long, n_shingles long, bits binary, bands array<long>")


def _confirm(pairs: DataFrame, left: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """pairs (a, b) with `ok`: denominator * |intersection| >= numerator * |union|; `left` has the sets of all a."""
    left = left.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def judge(batches):
        for batch in batches:
            ok = []
            for sa, sb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long, ok boolean")


def _links_across(members: DataFrame, profiles: DataFrame, n_hashes: int, least: float, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket: at least one for every two that any pair there links.

    `members`: bucket, band, id, component, n_shingles; `profiles`: id, bits, bands, shingles.
    A bucket's largest component only answers, its other members ask all. Both sides are
    dealt over blocks of bounded bytes. A pair that shares several buckets is compared in
    that of its first band; what passes the estimate is confirmed on the full sets, the best
    first, until one member asked is linked with the other component.
    """
    members = materialize(members, "members")
    per = members.groupBy("bucket", "band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("n_shingles") + 300).alias("w"))
    rank = F.struct("n", -F.col("component"))
    sizes = per.groupBy("bucket", "band").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max_by("component", rank).alias("largest"), F.max_by("w", rank).alias("lw")).where("kinds > 1")
    blocks, chunks = (F.ceil(F.col(c) / BLOCK_BYTES).cast("int") for c in ("total", "asked"))
    sizes = sizes.withColumn("asked", F.col("total") - F.col("lw")).select("bucket", "band", "largest", blocks.alias("blocks"), chunks.alias("chunks"))
    sizes = materialize(sizes, "sizes")  # so that the join shuffles both sides itself and adaptive execution can split a hot bucket
    rows = members.drop("n_shingles").join(sizes, ["bucket", "band"]).withColumn("minor", F.col("component") != F.col("largest"))
    columns = ("bucket", "band", "block", "chunk", "id", "component", "minor", "asks")
    block, chunk = (F.pmod(F.xxhash64(F.lit(k), "id"), F.col(c)).cast("int") for k, c in ((1, "blocks"), (2, "chunks")))
    held = rows.withColumns({"block": block, "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "asks": F.lit(False)}).select(*columns)
    asking = rows.where("minor").withColumns({"chunk": chunk, "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)}).select(*columns)

    def compare(batches):
        for batch in batches:
            found: list[tuple[int, int]] = []
            for band, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = members.values
                ids, comp, asks, minor = (got.field(k).to_numpy(zero_copy_only=False) for k in ("id", "component", "asks", "minor"))
                sig = np.frombuffer(b"".join(got.field("bits").to_pylist()), "<u8").reshape(len(ids), -1)
                keys = got.field("bands").flatten().to_numpy().reshape(len(ids), -1)
                sets = [np.frombuffer(x, "<u8") for x in got.field("shingles").to_pylist()]
                data = np.flatnonzero(~asks)
                for q in np.flatnonzero(asks):
                    hit = data[(comp[data] != comp[q]) & ~(minor[data] & (ids[data] >= ids[q]))]
                    est = estimates(sig[hit], sig[q], n_hashes)
                    passed = np.flatnonzero(est >= least)
                    hit = hit[passed[np.argsort(-est[passed], kind="stable")]]
                    hit = hit[(keys[hit] == keys[q]).argmax(axis=1) == band]
                    linked: set[int] = set()
                    for h in hit:
                        if comp[h] not in linked:
                            both = len(np.intersect1d(sets[h], sets[q], assume_unique=True))
                            if denominator * both >= numerator * (len(sets[h]) + len(sets[q]) - both):
                                linked.add(comp[h])
                                found.append((ids[h], ids[q]))
            cols = list(zip(*found, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    whole = held.unionByName(asking).join(profiles, "id")
    dealt = whole.groupBy("bucket", "band", "block", "chunk").agg(F.collect_list(F.struct("id", "component", "minor", "asks", "bits", "bands", "shingles")).alias("members"))
    links = materialize(dealt.where(F.exists("members", lambda m: m["asks"])).select("band", "members").mapInArrow(compare, "a long, b long"), "across")
    discard(members, sizes)
    return links


def _verdicts(texts: DataFrame, numerator: int, denominator: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, doc, n_shingles, component_id, kept) for each row of `texts` (id, text, doc), a table in buckets of id: ids are unique, docs need not be."""
    threshold, n_hashes = numerator / denominator, bands * rows
    docs = bucketed(sketches(texts, shingle, bands, rows), "id", "sketches", placed=True)
    first = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "id")).alias("first")
    classes = docs.where("class_a is not null").groupBy("class_a", "class_b").agg(first).select("class_a", "class_b", F.col("first.id").alias("rep"), F.col("first.doc").alias("doc"))
    classes = materialize(classes, "classes")
    reps = docs.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    keyed = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    # written first, so that the join shuffles both sides itself and adaptive execution can split a hot bucket
    shared = materialize(keyed.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "shared")
    buckets = materialize(keyed.join(shared, ["bucket", "band"]), "buckets")
    wanted = materialize(buckets.select("id").distinct(), "wanted")
    bits = bucketed(docs.join(wanted, "id", "left_semi").select("id", "bits", "bands"), "id", "bits", placed=True)

    def full_sets(batches):
        s = Sketcher(shingle, bands, rows)
        for batch in batches:
            out = [s.shingles(t).astype("<u8").tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "shingles"])

    sets = bucketed(texts.select("id", "text").join(wanted, "id", "left_semi").mapInArrow(full_sets, "id long, shingles binary"), "id", "sets", placed=True)
    discard(shared, wanted)

    least = cutoff(threshold, n_hashes)
    stars = buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()

    def pass_estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array(estimates(x, y, n_hashes) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    # the first member of a bucket may have a great many others: written on its own, so that the joins on it shuffle both sides and can be split
    centres = materialize(stars.select(F.col("a").alias("id")).distinct(), "centres")
    their_bits, their_sets = (materialize(t.join(centres, "id", "left_semi"), "of_centres") for t in (bits, sets))
    left, right = (t.select(F.col("id").alias(k), F.col("bits").alias(f"bits_{k}")) for t, k in ((their_bits, "a"), (bits, "b")))
    likely = stars.join(left, "a").join(right, "b").select("a", "b", "bits_a", "bits_b").mapInArrow(pass_estimate, "a long, b long")
    tested = materialize(_confirm(likely, their_sets, sets, numerator, denominator), "tested")
    discard(centres, their_bits, their_sets)

    parts = connected_components(tested.where("ok").select("a", "b"))
    placed = buckets.where("n > 2").select("bucket", "band", "id", "n_shingles").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))  # the only pair of a bucket of two is tested
    across = _links_across(placed, bits.join(sets, "id"), n_hashes, least, numerator, denominator)
    discard(bits, sets, buckets, tested)
    known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
    first_parts, parts = parts, connected_components(known.unionByName(across))
    discard(first_parts, across)

    linked = classes.join(parts.select(F.col("id").alias("rep"), "component"), "rep")
    least_row = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "class_a", "class_b", "rep")).alias("head")
    heads = linked.select("rep", "component").join(linked.groupBy("component").agg(least_row), "component").select("rep", "head")
    judged = classes.join(heads, "rep", "left").select("class_a", "class_b", F.when(F.col("head").isNull(), F.struct("doc", "rep")).otherwise(F.struct("head.doc", "head.rep")).alias("head"))
    judged = materialize(judged, "judged")  # a hot class is split, as above
    found = docs.select("id", "doc", "n_shingles", "class_a", "class_b").join(judged, ["class_a", "class_b"], "left")
    alone = F.col("head").isNull()
    return found.select("id", "doc", "n_shingles", F.when(alone, F.col("doc")).otherwise(F.col("head.doc")).alias("component_id"), (alone | (F.col("head.rep") == F.col("id"))).alias("kept"))


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col("key").alias("id"), F.col("row")[text_col].alias("text"), F.col("row")[id_col].alias("doc"))


def near_duplicates(df: DataFrame, numerator: int = 80, denominator: int = 100, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bands: int = 24, rows: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Rows are linked where
    denominator * |intersection| >= numerator * |union| of their sets of distinct shingles;
    one with fewer words than a shingle has its whole sequence as the only one. A null text,
    or one without words, has an empty set and stays alone.

    component_id is the smallest id of the group, null where all its rows have a null id; kept
    holds for exactly one row of the group, one with that id. Rows are told apart by their
    place, not by id: k repeated rows give k rows of one group, rows that share an id (or have
    none) are linked by their texts alone. Ids may be of any type that has an order. Other
    columns of `df` are not read.
    """
    found = _verdicts(_texts(numbered(df, [id_col, text_col]), id_col, text_col), numerator, denominator, shingle, bands, rows)
    return found.select(F.col("doc").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(df: DataFrame, numerator: int = 80, denominator: int = 100, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bands: int = 24, rows: int = 4) -> DataFrame:
    """`df` with the one row of each group that `near_duplicates` keeps; null and repeated ids are no exception."""
    whole = numbered(df, df.columns)
    found = _verdicts(_texts(whole, id_col, text_col), numerator, denominator, shingle, bands, rows)
    return whole.join(found.where("kept").select(F.col("id").alias("key")), "key", "left_semi").select("row.*")
