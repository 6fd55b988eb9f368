"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethanode.scratch import bucketed, discard, materialize  # noqa: F401  (part of this module's interface)

#: The six ASCII characters between words; a word is a run of anything else.
WHITE_SPACE = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, its rows dealt over all cores if it is a table of fewer files than cores and too few bytes to give each core a part of its own.

    A small file is often one row group, which one task reads; what is then done to its texts
    would keep one core busy. Tables of many files or bytes are not moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    part = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * part else df


#: Rows that Python tasks are handed at a time, at most.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands Python `BATCH_ROWS` rows at a time at most: 10,000 documents, as it would by itself, can take hundreds of MB outside an executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key, row), written in buckets of the key: the columns of each row under a number of its own, whatever its id."""
    row = F.struct(*[F.col(c) for c in dict.fromkeys(columns)])
    return bucketed(df.select(F.monotonically_increasing_id().alias("key"), row.alias("row")), "key", "rows", "zstd")


def words_column(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


class WordHashes(dict):
    """Word bytes to 64-bit hash, one for each seed, remembered up to a bound."""

    def __init__(self, bound: int = 400_000, seed: int = 0):
        super().__init__()
        self.bound, self.seed = bound, seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= self.bound:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; fewer words give one hash of them all."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        out = np.array([n], np.uint64)
        for j in range(n):
            out = mixed(out * _SPREAD + h[j : j + 1])
        return out
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _SPREAD + h[j : n - k + 1 + j]
    return mixed(out)


class WordScanner:
    """Places and hashes of the words of a text, without a Python object for most words.

    A short word's hash is the polynomial of its bytes, each a random number, by differences of
    prefix sums, modulo 2**64. Long words could be built so that their polynomials agree for
    every base, so those of over `SHORT` bytes have a seeded hash that mixes its input.
    """

    #: Bytes of the longest word with a polynomial.
    SHORT = 16

    #: Bytes summed at a time, more only where one word is longer.
    BLOCK = 1 << 20

    def __init__(self, seeds: tuple[int, ...] = (0,)):
        self.space = np.zeros(256, bool)
        self.space[list(WHITE_SPACE.encode())] = True
        self.codes, self.bases, self.seeds = [], [], seeds
        for seed in seeds:
            rng = np.random.default_rng(seed + 101)
            self.codes.append(rng.integers(0, 1 << 64, 256, dtype=np.uint64))
            self.bases.append(int(rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 3)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        """Powers of the bases, and of their inverses, for n places."""

        def powers(base: int) -> np.ndarray:
            return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base % (1 << 64), np.uint64))])

        self.up, self.down = [powers(b) for b in self.bases], [powers(pow(b, -1, 1 << 64)) for b in self.bases]

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(starts, ends, hashes by seed) of the words, in bytes."""
        data = np.frombuffer(text, np.uint8)
        blank = np.concatenate([[True], self.space[data], [True]])
        starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        hashes = [np.empty(len(starts), np.uint64) for _ in self.codes]
        lo = 0
        while lo < len(starts):
            begin = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, begin + self.BLOCK, "right")))
            part = data[begin : int(ends[hi - 1])]
            if len(part) >= len(self.up[0]):
                self._grow(2 * len(part) + 1)
            a, b = starts[lo:hi] - begin, ends[lo:hi] - begin
            for out, codes, up, down in zip(hashes, self.codes, self.up, self.down, strict=True):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(codes[part] * up[: len(part)])])
                out[lo:hi] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _SPREAD)
            lo = hi
        for i in np.flatnonzero(ends - starts > self.SHORT).tolist():
            word = text[starts[i] : ends[i]]
            for out, seed in zip(hashes, self.seeds, strict=True):
                out[i] = xxhash.xxh3_64_intdigest(word, seed + 1)
        return starts, ends, hashes
