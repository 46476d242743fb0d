"""Token ids of whole texts by a public tokenizer file, with a bounded cache of encoded pieces.

A batch of texts is cut at single spaces that no token crosses; its distinct pieces are looked up, those not
known are encoded, and the ids of all texts are gathered from them. The ids are those of encoding each text
whole; ``tests/llm`` compares both.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import only, released

#: Pieces in each of the two generations of a worker's cache, and the longest kept: at most some 200 MB.
GENERATION, CACHE_CHARS = 500_000, 64

#: White space by Unicode or by Python, beside a space.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_BESIDE_SPACE = f" {_WHITE}|{_WHITE} "
#: Where a token must end: a mark behind a letter or digit, but for the marks of 's and the like,
#: those that combine, and the letter whose lower case ends in one.
_MARK_BEHIND_WORD = r"([^\PL\x{130}]|\pN)([^\pL\pN\pM\s'])"
#: The characters that byte-level vocabularies write for bytes: themselves where printable, else from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(name: str, cached: int = GENERATION) -> "Encoder":
    """The worker's own encoder of a tokenizer file, by its name in the public folder or by path, with so many pieces in
    each generation of its cache."""
    only("tokens", _ENCODERS)
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    _ENCODERS[name].generation = cached
    return _ENCODERS[name]


def ranks_of(name: str):
    """A tiktoken encoding of a file of ranks in the public folder, or by path."""
    import public_tokenizers
    import tiktoken

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        #: A byte-level vocabulary joins a space to the word after it; a lower-casing one drops spaces.
        self.joins_space = self.tokenizer.normalizer is None
        self.lead = BYTE_CHARS[32] if self.joins_space else ""
        #: Text that spells a token added to the vocabulary gets that token's id, as the library does it.
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added, self.any_case = "|".join(re.escape(t.content) for t in tokens), any(t.normalized for t in tokens)
        self.marks = {"": []} | {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in ",."}
        self.generation = GENERATION
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. A piece of letters that the normalizer leaves alone is one word of the vocabulary's
        model, which gets it directly; the rest take the tokenizer's whole way."""
        out: list[bytes] = [b""] * len(pieces)
        rest, tokenize, joins, lead, marks = [], self.tokenizer.model.tokenize, self.joins_space, self.lead, self.marks
        for i, x in enumerate(pieces):
            word, mark = (x[:-1], x[-1]) if joins and x[-1:] in (",", ".") else (x, "")
            if word.isalpha() and (joins or (word.islower() if word.isascii() else word == word.lower() and is_normalized("NFC", word))):
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
                ids = [t.id for t in tokenize(lead + shown)]
                if mark:
                    ids += marks[mark]
                out[i] = array("I", ids).tobytes()
            elif x or joins:
                rest.append(i)
        if rest:
            space = " " if joins else ""
            found = self.tokenizer.encode_batch_fast([space + pieces[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, found, strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each behind a space; pieces in use move to the young generation."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        if old and new:
            missed, new = new, []
            for i in missed:
                found = out[i] = old.get(pieces[i])
                if found is None:
                    new.append(i)
                else:
                    young[pieces[i]] = found
        if new:
            asked = [pieces[i] for i in new]
            found = self._encoded(asked)
            for i, x, ids in zip(new, asked, found):
                out[i] = ids
                if len(x) <= CACHE_CHARS:
                    young[x] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text's ids; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.array([], "<u4"), np.zeros(1, np.int64)
        heads: list[bytes] = []
        # A text that spells an added token stays whole, and so does one with white space beside a space.
        beside = _BESIDE_SPACE if self.joins_space else None
        odd = np.zeros(len(texts), bool)
        for pattern in filter(None, (beside, self.added)):
            odd |= pc.match_substring_regex(texts, pattern, ignore_case=pattern is not beside and self.any_case).to_numpy(zero_copy_only=False)
        whole = texts.filter(pa.array(odd)).to_pylist()
        texts = pc.if_else(pa.array(odd), "", texts) if whole else texts
        if not self.joins_space:
            # No token holds white space, or both a letter and a mark. A-Z alone are lowered here.
            texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
            texts = pc.replace_substring_regex(texts, _MARK_BEHIND_WORD, r"\1 \2")
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy().astype(np.int64)
        table = self._known(pieces.dictionary.to_pylist()) if len(codes) else []
        # What comes first has no space before it.
        at = np.arange(len(texts)) if self.joins_space else np.flatnonzero(odd)
        if len(at):
            first, rest = cut.flatten().take(pa.array(bounds[at])).to_pylist(), iter(whole)
            found = self.tokenizer.encode_batch_fast([next(rest) if odd[i] else x for i, x in zip(at, first)], add_special_tokens=False)
            heads = [np.array(e.ids, dtype="<u4").tobytes() for e in found]
            codes[bounds[at]] = len(table) + np.arange(len(heads))
        # The pieces' ids as binary values: taking them puts all ids end to end.
        taken = pa.array(table + heads, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        flat = np.frombuffer(taken.buffers()[2] or b"", "<u4")[ends[0] // 4 : ends[-1] // 4] if len(taken) else np.zeros(0, "<u4")
        return flat, (ends // 4 - ends[0] // 4)[bounds] if len(taken) else np.zeros(len(bounds), np.int64)

    def encode_with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an end id behind each text."""
        ids, bounds = self.encode(texts)
        return np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))


def portions(batch: pa.RecordBatch, text: int, size: int = 4_000_000, give_back: bool = True) -> Iterator[pa.RecordBatch]:
    """A batch in portions whose texts, in column ``text``, have about so many bytes. Behind each, what it took goes back (where
    memory matters more than the time it takes): a portion makes many small objects, which would else stay in pieces."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, np.cumsum(sizes, dtype=np.int64)
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(start, stop - start)
        if give_back:
            released()
        start = stop
