"""Secret scans: patterns for known shapes, and a token-efficiency test for random strings.

Text that a vocabulary knows takes few tokens; a random string takes nearly one for every two characters.
Runs of key-like characters whose characters a token are few are reported, after leaving out digests of known
lengths, UUIDs and identifiers of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import only, task
from .tokens import portions, ranks_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known digests (md5, sha1, sha224, sha256, sha384, sha512 in hexadecimal) and UUIDs aren't secrets by themselves.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Identifiers: words, or words and numbers, joined by _ - / or capital letters.
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[_/=+-]*")

SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three patterns, leftmost and not overlapping within a kind; those too short are dropped
    after matching. Positions are code points, ends exclusive."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def looks_random(run: str) -> bool:
    """Letters and digits mixed, and neither a known digest, a UUID nor an identifier."""
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return False
    return not (_DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run))


_VOCABULARIES: dict = {}


def _spans(text: str, vocabulary: str, max_ratio: float) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    found = base_spans(text)
    taken = sorted((s, e) for _, s, e in found)
    ends = list(accumulate((e for _, e in taken), max))
    for m in _RUN.finditer(text):
        run = m.group()
        if looks_random(run):
            # Of the base spans that begin before the run's end, does one end behind its start?
            before = bisect_left(taken, (m.end(),))
            if not (before and ends[before - 1] > m.start()) and len(run) <= max_ratio * len(_VOCABULARIES[vocabulary].encode_ordinary(run)):
                found.append(("random", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _ready(vocabulary: str) -> None:
    only("vocabularies", _VOCABULARIES)
    if vocabulary not in _VOCABULARIES:
        _VOCABULARIES[vocabulary] = ranks_of(vocabulary)


def scan(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.0, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add the spans found in each whole text, ordered by start and kind, as a column ``out``.

    kind random: a run of 20 or more key-like characters outside the base spans with at most ``max_ratio``
    characters a token. A null or empty text has no spans. All rows and columns stay, repeated rows too; a
    column named like ``out`` is replaced. Rows are read once, without a shuffle; texts are worked on whole, in
    portions of some MB.
    """

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ready(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in portions(batch, at):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in _spans(x or "", vocabulary, max_ratio)] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(SPAN))]))


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """Spans of these kinds as kind:start:end, comma-joined, as a column."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """A text with ``mark`` for each run of overlapping spans."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.0, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span in the text replaced by ``mark``; overlapping spans get one.

    Null texts stay null, empty ones empty, repeated rows as often as they came; other columns aren't touched,
    whatever their names. Rows are read once, without a shuffle."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ready(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in portions(batch, at):
                texts = [x and redacted(x, _spans(x, vocabulary, max_ratio), mark) for x in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
