"""Secret scans: three fixed patterns, and the token-efficiency test for random strings."""

from __future__ import annotations

import base64
import functools
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run is as long as it can be, so asking for the least length finds the same matches as dropping short ones after.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
_IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|[0-9]+(?:[+/_=-]+[0-9]*)*")
#: Characters of the shortest run that is tested; shorter random strings are left to the fixed patterns.
MIN_LENGTH = 16
#: Characters per token under which a run counts as random.
MAX_EFFICIENCY = 2.2
#: The same for runs without a digit: long compounds of plain words come down to 2.0, random mixed-case letters hardly ever up to it.
MAX_LETTERS_EFFICIENCY = 2.0
#: Letters alone in runs of under so many characters: compounds of plain words come down to 1.6, with capitals inside they are hardly ever words.
SHORT_LETTERS, MAX_SHORT_EFFICIENCY, MAX_SHORT_MIXED_EFFICIENCY = 20, 1.6, 1.75


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=8)
def _runs(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def most_efficient(run: str, most: float) -> float:
    """Characters per token under which a run counts as random: less where it has no digit, still less where it is short besides."""
    if re.search("[0-9]", run):
        return most
    if len(run) >= SHORT_LETTERS:
        return min(most, MAX_LETTERS_EFFICIENCY)
    plain = run[1:].islower() or not run.isalpha()
    return min(most, MAX_SHORT_EFFICIENCY if plain else MAX_SHORT_MIXED_EFFICIENCY)


def random_spans(text: str, vocabulary: str, max_efficiency: float = MAX_EFFICIENCY, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs of `min_length` or more key characters, letters alone included, that cost many tokens; digests of known lengths, UUIDs and numbers are left out."""
    found = []
    for m in _runs(min_length).finditer(text):
        run = m[0]
        if _DIGEST.fullmatch(run) or _IDENTIFIER.fullmatch(run) or not re.search("[A-Za-z]", run):
            continue
        tokens = len(encoding(vocabulary).encode_ordinary(run))
        if len(run) < most_efficient(run, max_efficiency) * tokens:
            found.append((m.start(), 3, m.end()))
    return found


def scan(text: str | None, vocabulary: str, max_efficiency: float = MAX_EFFICIENCY, min_length: int = MIN_LENGTH) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a text, each by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    # only a run of so many characters without white space can hold a candidate
    extra = random_spans(text, vocabulary, max_efficiency, min_length) if max(map(len, text.split()), default=0) >= min_length else []
    return base, sorted(base + extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_efficiency: float = MAX_EFFICIENCY, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, spans, base_spans): arrays of (start, kind, end) in code points, end exclusive.

    A null text counts as empty and has none. Texts of any length are scanned whole. Random
    strings shorter than `min_length` are found only where a fixed pattern has them. Spans come
    by start, then kind in the order of KINDS, and may overlap. Repeated rows each come out,
    ids may be null or of any type; an id column named like one of the arrays is an error of
    the caller, other columns of `df` are not read.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def find(batches):
        for batch in batches:
            both = [scan(t, vocabulary, max_efficiency, min_length) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x[i]] for x in both], span) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "spans", "base_spans"])

    shape = "array<struct<start: long, kind: string, end: long>>"
    return df.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, spans {shape}, base_spans {shape}")


def written_column(spans: str):
    """`kind:start:end`, comma-joined, of an array of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, vocabulary: str | None = None, text_col: str = "text", mark: str = "[SECRET]", max_efficiency: float = MAX_EFFICIENCY, min_length: int = MIN_LENGTH) -> DataFrame:
    """`df` with every span, overlapping ones joined, replaced by `mark`; other columns and null texts stay as they are."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    at = df.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for start, _, end in scan(text, vocabulary, max_efficiency, min_length)[1]:
            if end <= done:
                continue
            if start >= done:
                out += [text[done:start], mark]
            done = end
        return "".join([*out, text[done:]]) if out else text

    def each(batches):
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.column(at).type))

    return df.mapInArrow(each, df.schema)


