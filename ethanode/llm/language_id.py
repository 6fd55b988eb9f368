"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of one fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces (forward
algorithm), learned by expectation-maximisation over the words of labelled documents; the
probability of a text is the product over its words. Uniform prior over the languages.

Words of a block walk the vocabulary's trie together, one character a step, and the sums run
over the arcs so found, in logarithms: no word is too long and no probability too small.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Characters of the words whose sums are taken at a time.
BLOCK_CHARS = 200_000
#: Words whose sums a task remembers, and the longest of them.
_CACHE, _CACHED_LENGTH = 150_000, 64


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; anything else carries no language."""
    return _LETTERS.findall(text.lower()) if text else []


class Lattice:
    """The letter pieces of the vocabulary as a trie, its steps in an open hash table."""

    _MULTIPLIER, _BITS = np.uint64(0x9E3779B97F4A7C15), 19

    def __init__(self, vocabulary: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = np.array([names.index(f"<0x{b:02X}>") for b in range(256)])
        self.size = len(names)
        self.ids = {p: i for i, p in enumerate(names) if p.removeprefix("▁").isalpha() or p == "▁"}
        self.longest = max(map(len, self.ids))
        prefixes = sorted({p[:k] for p in self.ids for k in range(len(p) + 1)}, key=len)
        state = {p: s for s, p in enumerate(prefixes)}
        self.piece = np.array([self.ids.get(p, -1) for p in prefixes], np.int32)
        letters = {c: k for k, c in enumerate(sorted({c for p in self.ids for c in p}), 1)}
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = np.int64(len(letters) + 1)
        keys = np.array([state[p[:-1]] * int(self.letters) + letters[p[-1]] for p in prefixes[1:]], np.int64)
        self.keys, self.next = np.full(1 << self._BITS, -1, np.int64), np.full(1 << self._BITS, -1, np.int32)
        for key, slot, target in zip(keys.tolist(), self._slots(keys).tolist(), range(1, len(prefixes)), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self._BITS) - 1)
            self.keys[slot], self.next[slot] = key, target

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._MULTIPLIER) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after one more letter; -1 where no piece goes on so."""
        keys = state.astype(np.int64) * self.letters + letter
        slots = self._slots(keys)
        found, out = self.keys[slots], self.next[slots]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self._BITS) - 1)
            found[open_], out[open_] = self.keys[slots[open_]], self.next[slots[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] >= 0)]
        out[found != keys] = -1
        return out


@functools.lru_cache(maxsize=2)
def lattice(vocabulary: str) -> Lattice:
    return Lattice(vocabulary)


def blocks(words: list[str], chars: int = BLOCK_CHARS) -> Iterator[slice]:
    """Slices of `words` of about so many characters each."""
    lo = n = 0
    for i, w in enumerate(words):
        n += len(w) + 2
        if n >= chars:
            yield slice(lo, i + 1)
            lo, n = i + 1, 0
    if lo < len(words):
        yield slice(lo, len(words))


class Arcs:
    """All pieces that stand in the words of a block, as arcs between places.

    A word has a place before each of its characters (the first is the mark of a word's
    start) and one after the last. A character that no piece spells has an arc of its own,
    with a row past the vocabulary: the product of its UTF-8 bytes' pieces.
    """

    def __init__(self, words: list[str], lat: Lattice):
        codes = np.frombuffer(("▁" + "▁".join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        word = np.repeat(np.arange(len(words)), lengths)
        end = np.repeat(starts + lengths, lengths)
        letter = lat.letter[codes]
        at = np.arange(len(codes))
        state = lat.step(np.zeros(len(codes), np.int32), letter)
        lone = np.flatnonzero(lat.piece[state] < 0) if len(state) else at
        lone = np.union1d(lone, np.flatnonzero(state < 0))
        self.extra, which = np.unique(codes[lone], return_inverse=True)
        begin, size, row = [lone], [np.ones(len(lone), np.int64)], [lat.size + which]
        for d in range(1, lat.longest + 1):
            if d > 1:
                more = at + d - 1 < end[at]
                at, state = at[more], state[more]
                state = lat.step(state, letter[at + d - 1])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            piece = lat.piece[state]
            hit = piece >= 0
            begin.append(at[hit])
            size.append(np.full(hit.sum(), d))
            row.append(piece[hit])
        begin, self.d, self.row = np.concatenate(begin), np.concatenate(size), np.concatenate(row).astype(np.int64)
        self.word = word[begin]
        self.start = begin + self.word  # places: one more than characters in each word
        self.end = self.start + self.d
        self.places = len(codes) + len(words)
        self.first, self.last = starts + np.arange(len(words)), starts + lengths + np.arange(len(words))
        self.stride = lat.longest + 1

    def steps(self, rank: np.ndarray) -> list[np.ndarray]:
        """Arcs by ascending rank and length; within each step no two arcs of a word meet."""
        key = rank * self.stride + self.d
        order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways from a word's first place to each place; `logs`: rows x languages."""
        out = np.full((self.places, logs.shape[1]), -np.inf)
        out[self.first] = 0.0
        for arcs in self.steps(self.end - self.first[self.word]):
            end = self.end[arcs]
            out[end] = np.logaddexp(out[end], out[self.start[arcs]] + logs[self.row[arcs]])
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """The same from each place to the word's last one."""
        out = np.full((self.places, logs.shape[1]), -np.inf)
        out[self.last] = 0.0
        for arcs in self.steps(self.last[self.word] - self.start):
            start = self.start[arcs]
            out[start] = np.logaddexp(out[start], out[self.end[arcs]] + logs[self.row[arcs]])
        return out


def _with_extra(logs: np.ndarray, extra: np.ndarray, lat: Lattice) -> np.ndarray:
    """`logs` with a row for each character that only its bytes spell."""
    if not len(extra):
        return logs
    return np.vstack([logs, [logs[lat.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]].sum(axis=0) for c in extra.tolist()]])


def log_likelihoods(words: list[str], table: np.ndarray, vocabulary: str) -> np.ndarray:
    """Natural log of each word's probability, summed over segmentations: words x languages."""
    lat, logs, out = lattice(vocabulary), np.log(table), np.zeros((len(words), table.shape[1]))
    for part in blocks(words):
        arcs = Arcs(words[part], lat)
        out[part] = arcs.forward(_with_extra(logs, arcs.extra, lat))[arcs.last]
    return out


def expected_counts(words: list[str], weights: np.ndarray, probs: np.ndarray, vocabulary: str) -> np.ndarray:
    """Expected number of uses of each piece in the words, by forward and backward sums."""
    lat, logs = lattice(vocabulary), np.log(probs)[:, None]
    counts = np.zeros(lat.size)
    for part in blocks(words):
        arcs = Arcs(words[part], lat)
        all_logs = _with_extra(logs, arcs.extra, lat)
        alpha, beta = arcs.forward(all_logs)[:, 0], arcs.backward(all_logs)[:, 0]
        use = weights[part][arcs.word] * np.exp(alpha[arcs.start] + all_logs[arcs.row, 0] + beta[arcs.end] - alpha[arcs.last][arcs.word])
        sums = np.bincount(arcs.row, use, lat.size + len(arcs.extra))
        counts += sums[: lat.size]
        for ch, n in zip(arcs.extra.tolist(), sums[lat.size :], strict=True):
            np.add.at(counts, lat.byte_ids[list(chr(ch).encode("utf-8", "surrogatepass"))], n)
    return counts


def train(
    labelled: DataFrame,
    vocabulary: str | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    rounds: int = 3,
    smoothing: float = 0.1,
) -> tuple[list[str], np.ndarray]:
    """Fit the piece probabilities; returns the languages and a pieces x languages table.

    The fit uses every labelled document: words are counted in the tasks, and the sums run over
    the distinct words of each language. Rows without a language or text are left out; texts without a letter add nothing, and a language that
    has only such texts keeps its name with equal probabilities. Repeated rows each count.
    Without labels there are no languages.
    """
    vocabulary = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    size = lattice(vocabulary).size
    if not langs:
        return [], np.zeros((size, 0))

    def count(batches):
        for batch in batches:
            got: dict[str, dict[str, int]] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                mine = got.setdefault(lang, {})
                for w in letter_words(text):
                    mine[w] = mine.get(w, 0) + 1
                if len(mine) > _CACHE:
                    yield pd.DataFrame({"lang": lang, "word": list(mine), "n": list(mine.values())})
                    got[lang] = {}
            for lang, mine in got.items():
                if mine:
                    yield pd.DataFrame({"lang": lang, "word": list(mine), "n": list(mine.values())})

    counted = rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    table = np.full((size, len(langs)), 1.0 / size)
    try:
        for _ in range(rounds):
            now = labelled.sparkSession.sparkContext.broadcast(table)

            def expect(batches, now=now):
                for batch in batches:
                    for lang, part in batch.groupby("lang"):
                        c = expected_counts(list(part["word"]), part["n"].to_numpy(float), now.value[:, langs.index(lang)], vocabulary)
                        used = np.flatnonzero(c)
                        yield pd.DataFrame({"lang": lang, "piece": used.astype("int32"), "c": c[used]})

            sums = counted.mapInPandas(expect, "lang string, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()  # at most pieces x languages rows
            counts = np.full((size, len(langs)), smoothing)
            if len(sums):
                counts[sums["piece"], sums["lang"].map(langs.index)] += sums["c"]
            table = counts / counts.sum(axis=0)
            now.destroy()
    finally:
        counted.unpersist()
    return langs, table


class Scorer:
    """Log-likelihoods of texts under the languages of a table; remembers those of words."""

    def __init__(self, table: np.ndarray, vocabulary: str):
        self.table, self.vocabulary = table, vocabulary
        self.known: dict[str, int] = {}
        self.held, self.logs, self.chars = 0, np.empty((1 << 12, table.shape[1])), np.empty(1 << 12)

    def _remember(self, words: list[str]) -> None:
        """The words' sums beside those held; the room for them doubles."""
        end = self.held + len(words)
        if end > len(self.chars):
            room = max(end, 2 * len(self.chars))
            self.logs, self.chars = (np.concatenate([x[: self.held], np.empty((room - self.held, *x.shape[1:]))]) for x in (self.logs, self.chars))
        self.logs[self.held : end] = log_likelihoods(words, self.table, self.vocabulary)
        self.chars[self.held : end] = [len(w) for w in words]
        self.held = end

    def sums(self, texts: list[str | None], fits: bool = False) -> list[tuple[np.ndarray, np.ndarray | None, int] | None]:
        """(log-likelihoods, where asked for those a letter over its distinct words, and their number) of each text; None for one without letters."""
        words = [letter_words(t) for t in texts]
        if self.held > _CACHE:
            self.known, self.held = {}, 0
        new = [w for w in dict.fromkeys(itertools.chain(*words)) if w not in self.known]
        lettered = [w for w in new if any(map(str.isalpha, w))]  # signs like a superscript are no letters
        self.known.update(dict.fromkeys(new, -1))
        self.known.update(zip(lettered, itertools.count(self.held)))
        self._remember(lettered)
        out = []
        for row in words:
            at = np.fromiter(map(self.known.__getitem__, row), np.int64, len(row))
            at = at[at >= 0]
            if not len(at):
                out.append(None)
                continue
            once = np.unique(at) if fits else at[:0]
            out.append((self.logs[at].sum(axis=0), self.logs[once].sum(axis=0) / self.chars[once].sum() if fits else None, len(once)))
        for w in new:
            if len(w) > _CACHED_LENGTH:
                del self.known[w]
        return out


def identify(df: DataFrame, langs: list[str], table: np.ndarray, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, fits: bool = False) -> DataFrame:
    """(id, lang_pred, score) per row: the likeliest language and its posterior probability.

    With `fits` also fit, the log-likelihood a letter of the text's distinct words under that
    language, and distinct_words; null and 0 where it is `und`.

    `columns` of `df`, where given, come out in place of the id; of these, the names of results
    are replaced. A null text, one without letters, and every text where `langs` is
    empty, gets `und` and score 0. Texts of any length are scored whole, a few at a time; ties
    go to the language that sorts first. Repeated rows each come out.
    """
    vocabulary = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    shared = df.sparkSession.sparkContext.broadcast(table)
    results = [StructField("lang_pred", StringType()), StructField("score", DoubleType())] + [StructField("fit", DoubleType()), StructField("distinct_words", LongType())] * fits
    names = [f.name for f in results]
    columns = [id_col] if columns is None else [c for c in columns if c not in names]
    rows_in = df.select(*columns, F.col(text_col).alias("__text"))
    out = StructType([*rows_in.schema.fields[:-1], *results])
    langs = list(langs)

    def score(batches):
        scorer = Scorer(shared.value, vocabulary) if langs else None
        for batch in batches:
            texts = batch.column(len(columns))
            found: list[tuple] = []
            lo = 0
            while lo < len(texts):
                hi, n, some = lo, 0, []
                while hi < len(texts) and n < BLOCK_CHARS:
                    some.append(texts[hi].as_py())
                    n += len(some[-1] or "")
                    hi += 1
                lo = hi
                for got in scorer.sums(some, fits) if langs else [None] * len(some):
                    if got is None:
                        found.append((UNDETERMINED, 0.0, None, 0))
                        continue
                    total, letters, distinct = got
                    best = int(total.argmax())
                    found.append((langs[best], float(1 / np.exp(total - total[best]).sum()), float(letters[best]) if fits else None, distinct))
            made = list(zip(*found, strict=True)) or [()] * 4
            cols = [pa.array(c, k) for c, k, _ in zip(made, (pa.string(), pa.float64(), pa.float64(), pa.int64()), names, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*columns, *names])

    return rows_in.mapInArrow(score, out)


#: Distinct words from which on a text's fit can speak against it.
FIT_WORDS = 20
#: A text is of no language if its fit lies below the middle of the language's labelled texts by FIT_REACH times the distance of their lowest hundredth, and by FIT_MARGIN (in logarithms; a letter) at least: texts of two languages, or with codes among the words, stay within that.
FIT_REACH, FIT_MARGIN = 3.0, 2.25


def least_fits(judged: DataFrame, lang_col: str = "lang") -> dict[str, float]:
    """For each language the fit under which a text is of none, by `FIT_REACH` and `FIT_MARGIN`, from all labelled rows of `identify` with `fits`.

    A language without labelled texts of `FIT_WORDS` distinct words in it has no bound.
    """
    own = judged.where((F.col(lang_col) == F.col("lang_pred")) & (F.col("distinct_words") >= FIT_WORDS))
    found = own.groupBy(F.col(lang_col).alias("lang")).agg(F.percentile_approx("fit", F.array(F.lit(0.01), F.lit(0.5)), F.lit(10_000)).alias("q")).collect()
    return {r["lang"]: r["q"][1] - max(FIT_REACH * (r["q"][1] - r["q"][0]), FIT_MARGIN) for r in found}
