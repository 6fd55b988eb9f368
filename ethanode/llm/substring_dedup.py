"""Repeated passages across documents, confirmed by window and located by phrase automata.

A window is a run of `window` words. Each window's anchor is the least hash of the shorter
runs in it, so equal windows have equal anchors. Steps:

1. Equal word sequences are one class; one document stands for each.
2. Anchors are counted over all classes; only windows whose anchor recurs can recur.
3. Those windows are counted by 128 bits of hash (two seeds); what is found twice is confirmed,
   and one place of it is kept.
4. The words at these places are the phrases. They go to shards by their anchors, and so do the
   stretches of text around recurring anchors: all text in which a shard's phrases can stand.
5. Each shard's phrases are compiled into Aho-Corasick automata over its words, and its
   stretches stream through to locate every occurrence, by the words themselves.
6. The words covered are removed from the documents.

Shards grow in number with the phrases; one with much text is split by bytes, and the
automata hold a bounded number of phrases each, so neither a common passage nor a common
anchor makes a long task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import WordScanner, bucketed, discard, materialize, mixed, numbered

#: Words of an anchor's run.
GRAM = 8
#: Phrases of one automaton (a node for each word of a phrase), and of one shard, about.
AUTOMATON_PHRASES = 8_000
#: Bytes of text that one task of a shard streams, about.
PART_BYTES = 8_000_000
#: Windows that a task sends on at a time, about.
EMITTED = 50_000


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by doubling."""
    out, width, parts, at = h, 1, [], 0
    while width <= k:
        if k & width:
            parts.append((out, at))
            at += width
        if 2 * width <= k:
            out = mixed(out[: len(out) - width] * np.uint64(0x9E3779B97F4A7C15) + out[width:] + np.uint64(width))
        width *= 2
    n = len(h) - k + 1
    total = np.full(n, np.uint64(k))
    for part, start in parts:
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + part[start : start + n])
    return total


def _sliding(a: np.ndarray, k: int, best) -> np.ndarray:
    """best (minimum or maximum) of each k neighbours."""
    width = 1
    out = a
    while 2 * width <= k:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(a) - k + 1], out[k - width : k - width + len(a) - k + 1])


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, least): hashes of all runs of GRAM words, and each window's anchor."""
    grams = _runs(h, min(GRAM, window))
    return grams, _sliding(grams, window - min(GRAM, window) + 1, np.minimum)


def chosen_places(grams: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places whose run is the anchor of some window, ties included."""
    span = len(grams) - len(least) + 1
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, span, np.maximum) == grams)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def profiles(texts: DataFrame, window: int) -> DataFrame:
    """(id, n_words, class_a, class_b, anchors): anchors hold a hash for each chosen place."""

    def profile(batches):
        scanner = WordScanner((0, 1))
        for batch in batches:
            counts, first, second, found = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                starts, _, (h, g) = scanner.scan(text or b"")
                digest = xxhash.xxh3_128_digest(h.tobytes() + g.tobytes())
                counts.append(len(starts))
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(starts) < window:
                    found.append(np.zeros(0, np.int64))
                    continue
                grams, least = anchors(h, window)
                found.append(_signed(grams[chosen_places(grams, least)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_words", "class_a", "class_b", "anchors"])

    return texts.select("id", "text").mapInArrow(profile, "id long, n_words long, class_a long, class_b long, anchors array<long>")


def _candidates(h: np.ndarray, recurring: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, anchors) of the windows whose anchor recurs."""
    least, known = _signed(anchors(h, window)[1]), np.sort(recurring)
    starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)
    return starts, least[starts]


def window_keys(hits: DataFrame, window: int) -> DataFrame:
    """(key_a, key_b, id, start, n) for every window with a recurring anchor; n as often as its class is found."""

    names = ["key_a", "key_b", "id", "start", "n"]

    def emit(batches):
        scanner, held, n = WordScanner((0, 1)), [], 0
        for batch in batches:
            for key, text, recurring, copies in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                _, _, (h, g) = scanner.scan(text)
                starts, _ = _candidates(h, recurring.values.to_numpy(zero_copy_only=False), window)
                held.append((_signed(_runs(h, window))[starts], _signed(_runs(g, window))[starts], np.full(len(starts), key), starts.astype(np.int32), np.full(len(starts), min(copies, 2), np.int32)))
                n += len(starts)
                if n >= EMITTED:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    return hits.select("id", "text", "recurring", "copies").mapInArrow(emit, "key_a long, key_b long, id long, start int, n int")


def _stretches(starts: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places in `starts` of the runs of windows that are neighbours of one shard."""
    cuts = np.flatnonzero((np.diff(starts) != 1) | (np.diff(shards) != 0))
    edge = np.arange(len(starts))
    return np.concatenate([edge[:1], cuts + 1]), np.concatenate([cuts, edge[-1:]])


def phrases_and_stretches(hits: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, phrase, id, first, words) of `hits` (id, text, recurring, starts).

    A row is a stretch of windows with recurring anchors, or, where `phrase` holds, one of
    windows that stand here for a confirmed phrase each.
    """

    def emit(batches):
        scanner = WordScanner()
        for batch in batches:
            shard, phrase, ids, first, out = [], [], [], [], []
            for key, text, recurring, chosen in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3), strict=True):
                begins, ends, (h,) = scanner.scan(text)
                starts, least = _candidates(h, recurring.values.to_numpy(zero_copy_only=False), window)
                own = least % shards
                stands = np.isin(starts, chosen.values.to_numpy(zero_copy_only=False)) if chosen.is_valid else np.zeros(len(starts), bool)
                for kind, some in ((False, slice(None)), (True, stands)):
                    s, o = starts[some], own[some]
                    lo, hi = _stretches(s, o)
                    shard.append(o[lo])
                    phrase.append(np.full(len(lo), kind))
                    ids.append(np.full(len(lo), key))
                    first.append(s[lo])
                    out += [text[a:b] for a, b in zip(begins[s[lo]].tolist(), ends[s[hi] + window - 1].tolist(), strict=True)]
            if not shard:
                continue
            cols = [*(pa.array(np.concatenate(c)) for c in (shard, phrase, ids, first)), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "phrase", "id", "first", "words"])

    return hits.select("id", "text", "recurring", "starts").mapInArrow(emit, "shard long, phrase boolean, id long, first long, words binary")


def automata(phrases: list[bytes], window: int, most: int) -> Iterator[tuple[dict[bytes, int], ahocorasick.Automaton]]:
    """(numbers of the words, automaton) for each `most` windows of the phrases, or about."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for text in phrases:
        coded = tuple(numbers.setdefault(w, len(numbers)) for w in text.split())
        for at in range(len(coded) - window + 1):
            automaton.add_word(coded[at : at + window])
        if len(automaton) >= most:
            automaton.make_automaton()
            yield numbers, automaton
            numbers, automaton = {}, ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    if len(automaton):
        automaton.make_automaton()
        yield numbers, automaton


def locate(window: int, phrases: pa.Table, texts: pa.Table) -> pa.Table:
    """Occurrences (id, first, last) of a shard's phrases in its stretches; last is exclusive, runs may overlap."""
    ids, starts, ends = [], [], []
    for numbers, automaton in automata(phrases.column("phrase_words").to_pylist(), window, AUTOMATON_PHRASES):
        unknown = len(numbers)

        @functools.lru_cache(maxsize=20_000)  # copies of a passage bring the same stretch again
        def found(text: bytes, numbers=numbers, automaton=automaton, unknown=unknown) -> list[tuple[int, int]]:
            runs, begin, end = [], -1, -1
            for last, _ in automaton.iter(tuple([numbers.get(w, unknown) for w in text.split()])):
                if last - window + 1 > end:
                    if end >= 0:
                        runs.append((begin, end + 1))
                    begin = last - window + 1
                end = last
            return [*runs, (begin, end + 1)] if end >= 0 else runs

        for key, first, text in zip(texts.column("id").to_pylist(), texts.column("first").to_pylist(), texts.column("words"), strict=True):
            for begin, end in found(text.as_py()):
                ids.append(key)
                starts.append(first + begin)
                ends.append(first + end)
    return pa.table({"id": pa.array(ids, pa.int64()), "first": pa.array(starts, pa.int64()), "last": pa.array(ends, pa.int64())})


def repeated_passages(texts: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of `texts` (id, text), a table in buckets of id, ids unique.

    documents: id, n_words, rep (the document with the same words that stands for it).
    spans: rep, first, last for every run of words that windows found elsewhere cover; they
    may overlap. A document that has copies has its spans like all others.
    """
    docs = bucketed(profiles(texts, window), "id", "profiles", placed=True)
    # written first, like the tables below, so that the join shuffles both sides itself and adaptive execution can split a hot key
    classes = materialize(docs.groupBy("class_a", "class_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    members = materialize(docs.select("id", "n_words", "class_a", "class_b").join(classes, ["class_a", "class_b"]).select("id", "n_words", "rep"), "members")
    reps = classes.select(F.col("rep").alias("id"), "copies")
    placed = materialize(docs.where(F.size("anchors") > 0).join(reps, "id").select("id", "copies", F.explode("anchors").alias("anchor")), "anchors")
    discard(classes, docs)
    often = materialize(placed.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "often")
    found = materialize(placed.join(often, "anchor").groupBy("id").agg(F.first("copies").alias("copies"), F.collect_set("anchor").alias("recurring")), "found")
    discard(placed, often)
    hits = bucketed(texts.select("id", "text").join(found, "id").select("id", "text", "recurring", "copies"), "id", "hits", "zstd", placed=True)
    discard(found)

    places = window_keys(hits, window).groupBy("key_a", "key_b").agg(F.sum("n").alias("n"), F.min(F.struct("id", "start")).alias("at")).where("n > 1")
    confirmed = materialize(places.groupBy(F.col("at.id").alias("id")).agg(F.collect_list("at.start").alias("starts")), "confirmed")  # of one text, so no longer than it
    shards = max(1, -(-(confirmed.agg(F.sum(F.size("starts"))).first()[0] or 0) // AUTOMATON_PHRASES))
    both = materialize(phrases_and_stretches(hits.join(confirmed, "id", "left"), window, shards), "stretches", "zstd")
    discard(hits, confirmed)
    around, phrases = both.where("not phrase").drop("phrase"), both.where("phrase").select(F.col("shard").alias("own"), F.col("words").alias("phrase_words"))
    parts = materialize(around.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("words")) / PART_BYTES)).cast("int").alias("parts")), "parts")
    dealt = around.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int")).drop("parts")
    spread = phrases.join(parts, F.col("own") == F.col("shard")).select("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"), "phrase_words")

    def one_shard(phrases: pa.Table, texts: pa.Table) -> pa.Table:
        return locate(window, phrases, texts)

    spans = materialize(spread.groupBy("own", "own_part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(one_shard, "id long, first long, last long"), "spans")
    discard(both, parts)
    return members, spans.withColumnRenamed("id", "rep")


def drop_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text): each document without the words that repeated windows cover.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; kept ones are joined by one space. A window
    repeats if its words also start anywhere else, in the same document included; windows are
    judged on the input. Null and wordless texts keep the empty text; those shorter than a
    window lose nothing. Rows are told apart by their place, not by id: each row comes out once
    with its own text's words, and repeated rows, or rows that share an id or have none, count
    as elsewhere for each other. Ids may be of any type; other columns of `df` are not read.
    """
    rows = numbered(df, [id_col, text_col])
    texts = rows.select(F.col("key").alias("id"), F.col("row")[id_col].alias("doc"), F.col("row")[text_col].alias("text"))
    members, spans = repeated_passages(texts, window)
    per = materialize(spans.groupBy("rep").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "per")
    joined = members.join(per, "rep").select("id", "spans")
    rows = texts.join(joined, "id", "left").select("doc", "text", "spans")
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                counts.append(len(words))
                stay = np.ones(len(words), bool)
                for s in spans or ():
                    stay[s["first"] : s["last"]] = False
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(w for w, k in zip(words, stay, strict=True) if k).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(cut, f"doc {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("doc", id_col)
