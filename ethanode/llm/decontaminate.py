"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are parted by the size of their shingle sets. The items of a part with sizes up to
u keep their k = floor((1 - c) u) + 1 smallest shingle hashes (bottom-k minima); a document
that contains a share c of an item's shingles misses at most floor((1 - c) n) of its n, so it
holds one of these minima, however long it is. The items of which a document holds a minimum,
and only those, are confirmed by exact containment on full shingle sets. Each block of items is
one more pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ethanode.llm.common import WordHashes, shingle_hashes

#: Shingles of test items that one broadcast block holds (8 bytes each, and 16 more for their items).
BLOCK_SHINGLES = 4_000_000


def minima_kept(size: int, numerator: int, denominator: int) -> int:
    """Minima kept by an item whose set has `size` shingles: its part's bound is the next power of two."""
    bound = 1 << max(size - 1, 0).bit_length()
    return min(size, (denominator - numerator) * bound // denominator + 1)


class ItemIndex:
    """Shingle sets of one block of items, and their minima."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, numerator: int, denominator: int):
        hashes = WordHashes()
        self.ids, self.sizes, keys, owners, low = [], [], [], [], []
        for item, text in items:
            own = np.unique(shingle_hashes(hashes.of(text.lower().split()), shingle))
            if not len(own):
                continue
            at = len(self.ids)
            self.ids.append(item)
            self.sizes.append(len(own))
            keys.append(own)
            owners.append(np.full(len(own), at))
            low.append(own[: minima_kept(len(own), numerator, denominator)])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.keys, self.owners = cat(keys, np.uint64), cat(owners, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.minima, self.minima_owners = cat(low, np.uint64), np.repeat(np.arange(len(low)), [len(x) for x in low])
        order = np.argsort(self.minima, kind="stable")
        self.minima, self.minima_owners = self.minima[order], self.minima_owners[order]

    def found_in(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its size, shared shingles) for items that share a minimum with the shingles."""
        if not len(self.minima) or not len(shingles):
            return []
        at = np.minimum(np.searchsorted(self.minima, shingles), len(self.minima) - 1)
        if not (self.minima[at] == shingles).any():
            return []  # most documents
        shingles = np.unique(shingles)
        candidates = np.unique(self.minima_owners[_places(self.minima, shingles)])
        owners = self.owners[_places(self.keys, shingles)]
        owners, shared = np.unique(owners[np.isin(owners, candidates)], return_counts=True)
        return [(self.ids[o], self.sizes[o], int(n)) for o, n in zip(owners, shared, strict=True)]


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted `keys` of all that equal one of the distinct `wanted`."""
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    runs = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())


def _indexes(spark, benchmark: DataFrame, item_col: str, item_text_col: str, numerator: int, denominator: int, shingle: int):
    """A broadcast index of each block of items."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    weight = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-weight // (4 * BLOCK_SHINGLES)))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        held = [(r["item"], r["text"].encode()) for r in mine.toLocalIterator()]
        yield spark.sparkContext.broadcast(ItemIndex(held, shingle, numerator, denominator))


def contained_items(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", numerator: int = 80, denominator: int = 100, shingle: int = 5) -> DataFrame:
    """(id, item, n_item, n_shared): each document and test item of which it contains the share.

    denominator * n_shared >= numerator * n_item over distinct shingles of words
    (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); fewer words than a shingle make one shingle of
    all, for items as for documents. Null and wordless texts contain nothing and are contained
    nowhere. The items are taken in blocks of bounded size, each broadcast to one pass over
    the documents; repeated items and documents each count. Ids may be of any type, or null; an
    id column named n_item or n_shared, or both of one name, is an error of the caller.
    """
    doc_kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for index in _indexes(df.sparkSession, benchmark, item_col, item_text_col, numerator, denominator, shingle):

        def search(batches, index=index):
            hashes = WordHashes()
            for batch in batches:
                keys, rows = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    got = shingle_hashes(hashes.of((text or b"").lower().split()), shingle)
                    for item, size, shared in index.value.found_in(got):
                        if denominator * shared >= numerator * size:
                            keys.append(key)
                            rows.append((item, size, shared))
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(cols[0], item_arrow), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, item_col, "n_item", "n_shared"])

        found = df.select(F.col(id_col), F.col(text_col)).mapInArrow(search, f"`{id_col}` {doc_kind}, `{item_col}` {item_kind}, n_item long, n_shared long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", numerator: int = 80, denominator: int = 100, shingle: int = 5) -> DataFrame:
    """`df` without the rows that contain a test item, as in `contained_items`.

    Each row is judged by its own text, whatever its id: clean rows with a null id stay, and
    rows that share an id with a contaminated one do not go with it.
    """
    at = df.columns.index(text_col)
    for index in _indexes(df.sparkSession, benchmark, item_col, item_text_col, numerator, denominator, shingle):

        def clean(batches, index=index):
            hashes = WordHashes()
            for batch in batches:
                stays = []
                for text in batch.column(at).cast(pa.binary()).to_pylist():
                    got = shingle_hashes(hashes.of((text or b"").lower().split()), shingle)
                    stays.append(not any(denominator * shared >= numerator * size for _, size, shared in index.value.found_in(got)))
                yield batch.filter(pa.array(stays, pa.bool_()))

        df = df.mapInArrow(clean, df.schema)
    return df
