"""Spelling variant grouping by pivotal grams: words one edit apart, found by a similarity join.

Bigrams are ordered by how many words hold them. A word's prefix is its 2 * edits + 1 rarest
bigrams (for one edit three, and all that are as rare as the last of them); its pivots are two
of these that do not overlap, chosen by dynamic programming so that few words hold them. One
edit leaves one of two disjoint bigrams as it was. So of two words one edit apart, a pivot of
the one whose prefix ends with the rarer bigram stands in the other's prefix, and, as the edit
lies on one side of it, what lies on its other side is the same: an index of pivots by the
bigram and all before it, or all after it, is joined with the prefixes by the same keys. What
meets is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import discard, materialize

#: A run of letters; bigrams of runs number at most 90 * 90, as A-Z are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
GRAM = 2
#: Code points of the longest word that is found by its bigrams; of longer ones, however long and uniform, one half stays as it was.
LONG = 64
_ALWAYS = (1 << 31) - 1
#: Characters of a long text read at a time, and words that a task counts before it sends them on.
CHUNK = 1 << 20
HELD_WORDS = 200_000


def runs(text: str):
    """Lists of a text's runs, cut where no run is."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            edge = _OTHER.search(text, end)
            end = edge.start() if edge else len(text)
        yield RUN.findall(text, at, end)
        at = end


def garbled(doc_id, run: str, modulus: int = 97) -> str:
    """The run, A-Z lower-cased, without one code point where `modulus` divides h, the crc32 of `<doc_id>:<run>`: place h % length."""
    word = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, modulus: int | None = 97) -> DataFrame:
    """(word, n): words of at least `least_chars` code points found `least_count` times or more.

    Words are the maximal runs of A-Z, a-z and the code points from 00C0 to 00FF of whole texts,
    only A-Z lower-cased; with a modulus, runs lose a code point as in `garbled` (a null id
    counts as the empty string there). A task sums what it reads before anything is shuffled.
    """

    def count(batches):
        held: Counter = Counter()

        def out():
            words = [w for w in held if len(w) >= least_chars]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for part in runs(text or ""):
                    own.update(part)
                for run, n in own.items():
                    if len(run) >= least_chars:
                        held[garbled("" if key is None else key, run, modulus) if modulus else run.translate(_LOWER)] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = df.select(F.col(id_col).cast("string"), text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, tuple[int, str]]:
    """Each bigram's place in the order: by the number of words' places that hold it, then by itself. At most 8,100 of them."""
    places = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    return {r["gram"]: (r["count"], r["gram"]) for r in grams.groupBy("gram").count().collect()}


def chosen_pivots(prefix: list[tuple[int, int]], wanted: int) -> list[int]:
    """Places of `wanted` bigrams of the prefix (place, how many hold it; by place) that do not overlap and that fewest words hold together.

    best[k][j] is the least sum for k of the first j; each bigram is taken after the last one that ends before it, or left.
    """
    n = len(prefix)
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] * (n + 1)] + [[None] * (n + 1) for _ in range(wanted)]
    before, at = [0] * n, 0
    for j, (place, _) in enumerate(prefix):
        while prefix[at][0] + GRAM <= place:
            at += 1
        before[j] = at
    for k in range(1, wanted + 1):
        for j in range(1, n + 1):
            place, cost = prefix[j - 1]
            least = best[k][j - 1]
            if (rest := best[k - 1][before[j - 1]]) is not None and (least is None or rest[0] + cost < least[0]):
                least = (rest[0] + cost, (*rest[1], place))
            best[k][j] = least
    return list(best[wanted][n][1]) if best[wanted][n] else []


def signature(word: str, order: dict[str, tuple[int, str]], edits: int = 1) -> tuple[tuple[int, str] | None, list[int], list[int]]:
    """(the prefix's last bigram in the order, places of the prefix, places of the pivots), places from 0; nothing for words that no near word's bigrams are compared with."""
    if len(word) > LONG + 1:
        return None, [], []
    grams = [(order[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1)]
    last = sorted(grams)[GRAM * edits][0]
    prefix = [(i, rank[0]) for rank, i in grams if rank <= last]
    return last, [i for i, _ in prefix], chosen_pivots(prefix, edits + 1)


def odd_letters(word: str) -> int:
    """A bit for each letter, by its code point modulo 64, set where the word has an odd number of it: one edit turns two bits at most."""
    out = 0
    for c in word:
        out ^= 1 << (ord(c) & 63)
    return out - (1 << 64) if out >> 63 else out


def signatures(words: DataFrame, order: dict[str, tuple[int, str]]) -> DataFrame:
    """(word, n, letters, last, prefix, pivots) of the words, with `odd_letters` and with `last` as a number that follows the order, -1 for long ones."""
    ranks = {gram: i for i, (gram, _) in enumerate(sorted(order.items(), key=lambda x: x[1]))}
    shared = words.sparkSession.sparkContext.broadcast((order, ranks))

    def sign(batches):
        order, ranks = shared.value
        for batch in batches:
            found = [signature(w, order) for w in batch.column(0).to_pylist()]
            cols = [pa.array([odd_letters(w) for w in batch.column(0).to_pylist()], pa.int64()), pa.array([ranks[x[0][1]] if x[0] else -1 for x in found], pa.int32()), *(pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["word", "n", "letters", "last", "prefix", "pivots"])

    return words.select("word", "n").mapInArrow(sign, "word string, n long, letters long, last int, prefix array<int>, pivots array<int>")


def _keyed(signed: DataFrame, places: str, lengths: Sequence[int]) -> DataFrame:
    """(key, word, n, letters, last) for each length that a near word may have, as a difference from the own one.

    Keys: that length, with the word up to the end of each place's bigram, and from its bigram
    on; for lengths over `LONG`, with the part that falls into a near word's first half, and into
    its second one.
    """
    chars = F.length("word")

    def keys(d: int) -> Column:
        size = chars + F.lit(d)
        half = F.floor(size / 2).cast("int")
        halves = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.lit(">"), F.substring("word", chars - size + half + 1, size - half)))
        sides = F.flatten(F.transform(places, lambda at: F.array(F.concat(F.lit("^"), F.substring("word", F.lit(1), at + GRAM)), F.concat(F.lit("$"), F.substring("word", at + 1, chars)))))
        return F.transform(F.when(size <= LONG, sides).otherwise(halves), lambda k: F.concat(size.cast("string"), k))

    return signed.select(F.explode(F.flatten(F.array(*[keys(d) for d in lengths]))).alias("key"), "word", "n", "letters", "last")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of distinct words that differ by one inserted, deleted or replaced code point.

    `words` (word, n) is a written table of distinct words of three code points or more of the alphabet of `RUN`.
    """
    signed = materialize(signatures(words, gram_order(words)), "signatures")
    pivots = materialize(_keyed(signed, "pivots", (-1, 0, 1)), "pivots")
    # both sides are written, so that the join shuffles them itself and adaptive execution can split a hot key
    prefixes = materialize(_keyed(signed, "prefix", (0,)).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letters").alias("near_letters"), F.when(F.length("word") > LONG, _ALWAYS).otherwise(F.col("last")).alias("near_last")), "prefixes")
    likely = (F.col("last") <= F.col("near_last")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2)
    met = pivots.join(prefixes, "key").where(likely & (F.col("word") != F.col("near")))
    one_way = materialize(met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n"), "near")
    discard(signed, pivots, prefixes)
    other = one_way.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return one_way.unionByName(other).distinct()


def forms(words: DataFrame, near: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, form, n_near, form_n): a word's form is its near word of largest n, the smallest in code-point order on ties, if that n is `factor` times its own or more."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    best_n = -F.col("best.less")
    is_form: Column = best_n >= factor * F.col("n")
    joined = words.join(found, "word", "left")
    return joined.select("word", "n", F.when(is_form, F.col("best.form")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, best_n).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """`formed`, a written table, with root: the last word when forms are followed.

    A form is found `factor` times as often as its word, so there are no circles; each round
    doubles how far a word looks, and there are as many as the logarithm of the longest way.
    """
    links = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        discard(links)
        links = further.drop("moved")
        links.scratch_path = further.scratch_path
        if not further.where("moved").limit(1).count():
            return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, factor: int = 2, modulus: int | None = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `word_counts`.

    A word's near words are those one edit (an inserted, deleted or replaced code point) away;
    form is the most frequent of them if `factor` times as frequent or more, else null, and
    root the end of the chain of forms, the word itself without one. Null, empty and wordless
    texts have no words, repeated rows and rows that share an id each count, a null id counts
    as the empty string, and a table without words gives no rows; other columns of `df` are not
    read. `modulus` None leaves the runs as they are.
    """
    words = materialize(word_counts(df, id_col, text_col, least_chars, least_count, modulus), "words")
    formed = materialize(forms(words, near_words(words), factor), "forms")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
