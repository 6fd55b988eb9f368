"""Packing of token sequences by the sum-of-squares rule.

A document's tokens are cut into pieces of at most the capacity; every piece, the longest
first, goes to the open bin that makes the sum of squares of the numbers of open bins, taken
over the residual gaps, smallest.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import materialize

CAPACITY = 2048
#: Pieces that one task packs together; more pieces make more groups.
GROUP_PIECES = 50_000


class WordIds(dict):
    """Run of bytes without ASCII white space to its token ids, little-endian uint32.

    The vocabulary drops white space and joins nothing across it, so a text's ids are those
    of its runs. Runs of printable ASCII are split by the vocabulary's pattern and their parts,
    in lower case, go straight to the BPE model, as do lower-case letters that no normalisation
    changes; all others, and what may hold a special token, go through the whole tokenizer, as
    they are. When `bound` runs are remembered, those used since that last happened stay.
    """

    _ASCII = re.compile(rb"[!-~]+")
    _PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # a fixed value: the vocabulary's pattern for printable ASCII

    def __init__(self, path: str, bound: int = 400_000):
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bound = self.tokenizer.model, bound
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}  # GPT-2's public byte alphabet

    def __missing__(self, run: bytes) -> bytes:
        value = self.older.pop(run, None)
        if value is None:
            parts = self._parts(run)
            value = self._ids(run) if parts == [run] else b"".join(map(self.__getitem__, parts))
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[run] = value
        return value

    def _parts(self, run: bytes) -> list[bytes]:
        """The runs whose ids make up those of `run`; itself alone where it is not put together."""
        if run.isalpha():  # ASCII letters
            return [run.lower()]
        body, stop = run[:-1], run[-1:]
        if stop in (b".", b",") and (body.isalpha() or self._plain(body)):
            return [body, stop]
        return self._PARTS.findall(run.lower()) if self._ascii(run) else [run]

    def _ascii(self, run: bytes) -> bool:
        return self._ASCII.fullmatch(run) is not None and b"<|" not in run

    @staticmethod
    def _plain(body: bytes) -> bool:
        """Lower-case letters so old that all versions of Unicode agree on them; composed, as they are letters."""
        word = body.decode("utf-8", "replace")
        return word.isalpha() and word == word.lower() and max(word) < "\u0250"

    def _ids(self, run: bytes) -> bytes:
        if self._ascii(run):
            ids = [t.id for t in self.model.tokenize(run.decode())]
        elif self._plain(run):
            ids = [t.id for t in self.model.tokenize(run.decode("latin-1").translate(self.shown))]
        else:
            ids = self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """This process's `WordIds`: one Python worker runs many tasks, which share the vocabulary read and the words known."""
    return WordIds(path)


def token_pieces(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece of each document.

    The ids are those of the tokenizer as its file has it: a special token spelt out in a text
    is one id. A null text counts as empty; every document ends in `end_id`, so an empty one
    has one piece of one token. Only documents longer than the capacity are cut. Repeated rows
    and rows without an id each have their pieces; other columns of `df` are not read.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        ids_of = word_ids(tokenizer).__getitem__
        for batch in batches:
            keys, rows, bodies = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                body = b"".join(map(ids_of, (text or b"").split())) + end
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[at : at + 4 * capacity]
                    keys.append(key)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        bodies.append(np.frombuffer(part, "<u4").astype("int32"))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(keys, batch.column(0).type), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            if with_ids:
                arrays.append(pa.array(bodies, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return df.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order.

    An item goes to the open bin that can take it for which the sum of squares of the numbers
    of open bins, over all residual gaps, becomes smallest; a new bin is opened only where
    none can take it. Ties go to the fullest bin.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, s in enumerate(lengths.tolist()):
        level = 0
        used = np.flatnonzero(count[1 : capacity - s + 1]) + 1
        if len(used):
            change = np.where(used + s < capacity, 2 * count[used + s] + 1, 0) - 2 * count[used] + 1
            level = int(used[np.flatnonzero(change == change.min())[-1]])
            b = open_bins[level].pop()
            count[level] -= 1
        else:
            b, made = made, made + 1
        bins[k], offsets[k] = b, level
        if level + s < capacity:
            open_bins[level + s].append(b)
            count[level + s] += 1
    return bins, offsets


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sequences for one group of pieces, longest first."""
    lengths = pieces["length"].to_numpy()
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
    return pieces.assign(sequence=bins, offset=offsets)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset.

    `pieces` is a written table: its rows are dealt by a hash of their place in it, so that
    rows with one id, or with none, spread like all others, to groups of about `group_pieces`;
    each group is packed on its own, so the work per task stays bounded. No row is dropped;
    equal rows are equal items.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    out = f"{dealt._jdf.schema().toDDL()}, sequence long, offset long"

    def packed_group(group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, capacity)

    packed = dealt.groupBy("__group").applyInPandas(packed_group, out)
    return packed.withColumn("sequence_id", F.col("__group") * F.lit(1 << 32) + F.col("sequence")).drop("__group", "sequence")


def pack_documents(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return pack(materialize(token_pieces(df, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)


def sequences(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves.

    Pieces are told apart by a number of their own, so rows that share an id, or have none,
    each have their tokens once, as in `token_pieces`; an empty table gives no sequence.
    """
    pieces = token_pieces(df, tokenizer, capacity, id_col=id_col, text_col=text_col, with_ids=True)
    pieces = materialize(pieces.select("length", "ids").withColumn("row", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.drop("ids"), capacity).select("row", "sequence_id", "offset")
    parts = packed.join(pieces.select("row", "ids"), "row")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
