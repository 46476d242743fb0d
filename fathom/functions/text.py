"""Text normalisation and scalar functions, as columns."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

CJK = r"[\x{4e00}-\x{9fff}]"
#: White space of every script.
BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """No byte order mark, zero-width space or control character; lines end in LF, spaces and tabs in them are single,
    white space of any script goes at their ends and stays inside; empty lines go."""
    return F.array_join(clean_lines(c), "\n")


def clean_lines(c: Column) -> Column:
    """The lines of ``clean``. A class of what stays is quicker than one of what goes; runs are sought in lines that have any."""
    c = F.regexp_replace(c, r"[^\x20-\x7e\t\n\r\x80-\x{200a}\x{200c}-\x{fefe}\x{ff00}-\x{10ffff}]", "")
    single = lambda x: F.when(F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)
    inner = lambda x: F.regexp_extract(x, rf"(?s)\A{BLANK}*+(.*[^{BLANK[1:-1]}])?", 1)
    return F.filter(F.transform(F.split(c, r"[\r\n]+"), lambda x: inner(single(x))), lambda x: x != "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def normalized_hash(c: Column) -> Column:
    """Hash that white space doesn't change."""
    return F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256)


def section_title(c: Column) -> Column:
    """The first line, trimmed, at most 80 characters."""
    return F.substring(strip(F.get(F.split(c, "\n"), F.lit(0))), 1, 80)


def language(c: Column) -> Column:
    return F.when(c.rlike(CJK), "zh").otherwise("en")


def token_estimate(c: Column) -> Column:
    """One token a CJK character, and one for four others, at least one; none for an empty text."""
    cjk = F.length(c) - F.length(F.regexp_replace(c, CJK, ""))
    rest = F.floor((F.length(c) - cjk) / 4)
    return F.when(F.length(c) == 0, 0).otherwise(cjk + F.greatest(F.lit(1), rest)).cast("long")


def truncated(c: Column, budget: Column | int) -> Column:
    """A text within the budget as it is, else the longest prefix whose characters cost at most budget - 1 (two a
    CJK character, one each other), with an ellipsis; trailing white space goes.

    As each character costs one at least, no prefix has more characters than the budget; a long text isn't split
    beyond that."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    most = F.substring(c, F.lit(1), F.greatest(budget, F.lit(1)).cast("int"))
    step = lambda acc, x: F.struct(
        (acc["cost"] + F.when(x.rlike(CJK), 2).otherwise(1)).alias("cost"),
        (acc["kept"] + F.when(acc["cost"] + F.when(x.rlike(CJK), 2).otherwise(1) <= F.greatest(budget - 1, F.lit(1)), 1).otherwise(0)).alias("kept"),
    )
    kept = F.aggregate(F.filter(F.split(most, ""), lambda x: x != ""), F.struct(F.lit(0).alias("cost"), F.lit(0).alias("kept")), step, lambda acc: acc["kept"])
    return F.when(token_estimate(c) <= budget, c).otherwise(F.concat(F.regexp_replace(F.substring(c, F.lit(1), kept), r"\s+$", ""), F.lit("…")))


def query_tokens(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """Distinct CJK runs of two or more, runs of ASCII letters and digits, and extra terms that occur, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"{CJK}{{2,}}|[a-z0-9]+"), F.lit(0))
    if extra:
        found = F.concat(found, F.filter(F.array(*map(F.lit, extra)), lambda x: F.contains(c, x)))
    return F.array_distinct(found)


def shingle_rows(c: Column) -> Column:
    """Character trigrams of letters and digits (c:) and word pairs (w:) of the case-folded text, as they come; what is
    shorter is one shingle. Each array is made in one pass over the text."""
    folded = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    letters = F.regexp_replace(folded, r"[^a-z0-9\x{4e00}-\x{9fff}]", "")
    words = F.regexp_extract_all(folded, F.lit(rf"[a-z0-9]+|{CJK}"), F.lit(0))
    none, rest = F.array().cast("array<string>"), F.size(words) - 1
    threes = F.transform(F.regexp_extract_all(letters, F.lit("(?=(...))"), F.lit(1)), lambda x: F.concat(F.lit("c:"), x))
    by_char = F.when(F.length(letters) >= 3, threes).when(F.length(letters) > 0, F.array(F.concat(F.lit("c:"), letters))).otherwise(none)
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda x, y: F.concat(F.lit("w:"), x, F.lit(" "), y))
    by_word = F.when(rest > 0, pairs).when(rest == 0, F.transform(words, lambda x: F.concat(F.lit("w:"), x))).otherwise(none)
    return F.concat(by_char, by_word)


def shingles(c: Column) -> Column:
    """The distinct shingles of a text."""
    return F.array_distinct(shingle_rows(c))


def mixed(columns: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(columns[0]), salt, np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


_WORD = re.compile(r"[a-z0-9]+|[\u4e00-\u9fff]")


#: Hashes of words that a worker has met.
_WORDS: dict[str, int] = {}


def _threes(letters: str) -> np.ndarray:
    """The distinct triples of three letters or more, as rows of code points."""
    if letters.isascii():
        x, bits, mask = np.frombuffer(letters.encode(), np.uint8).astype(np.uint32), 8, 0xFF
    else:
        x, bits, mask = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.uint64), 21, 0x1FFFFF
    kind = x.dtype.type
    key = np.unique(x[:-2] << kind(2 * bits) | x[1:-1] << kind(bits) | x[2:])
    return np.stack([key >> kind(2 * bits), key >> kind(bits) & kind(mask), key & kind(mask)], axis=1)


def hashed_shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers: those of ``shingles``, hashed; pairs of words are odd."""
    words = _WORD.findall((text or "").lower().replace("ß", "ss"))
    if not words:
        return np.array([], np.int64)
    letters = "".join(words)
    threes = _threes(letters).T if len(letters) >= 3 else np.array([[ord(x)] for x in letters])
    known = _WORDS
    if len(known) > 200_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    pairs = np.array([known[w] for w in words], np.uint64)
    pairs = [pairs[:-1], pairs[1:]] if len(words) > 1 else [pairs]
    one = np.uint64(1)
    return np.unique(np.concatenate([mixed(list(threes.astype(np.uint64)), 8 + len(threes)) & ~one, mixed(pairs, 16 + len(pairs)) | one])).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def shingle_hashes(texts: pd.Series) -> pd.Series:
    """Distinct shingles as numbers, for joins: in Arrow batches, as a shingle a character as a text of its own is
    what takes the time elsewhere."""
    return texts.map(hashed_shingles)


@F.pandas_udf(LongType())
def shingle_count(texts: pd.Series) -> pd.Series:
    """How many distinct shingles a text has."""
    return texts.map(lambda t: len(hashed_shingles(t)))


def _digest(folded: str | None) -> tuple[int, str | None]:
    words = _WORD.findall(folded or "")
    if not words:
        return 0, None
    letters = "".join(words)
    threes = np.ascontiguousarray(_threes(letters).astype("<u4")).view("<U3").reshape(-1).tolist() if len(letters) >= 3 else [letters]
    pairs = {f"w:{a} {b}" for a, b in zip(words, words[1:], strict=False)} if len(words) > 1 else {f"w:{words[0]}"}
    every = [*(f"c:{x}" for x in threes), *pairs]
    every.sort()
    return len(every), hashlib.sha256("|".join(every).encode()).hexdigest()


@F.pandas_udf(StructType([StructField("n", LongType()), StructField("digest", StringType())]))
def _shingle_digest(folded: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_digest(x) for x in folded], columns=["n", "digest"])


def shingle_digest(c: Column) -> Column:
    """n and digest of the distinct shingles of a text: how many, and the hash of all in order, joined by bars. No row or
    array of shingles is kept."""
    return _shingle_digest(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct items; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def quoted_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\"“「『《]([^\"“”「」『』《》]{2,30})[\"”」』》]"), F.lit(1)))


def title_topic(stem: Column) -> Column:
    """A file stem without version prefix, trailing date and separators."""
    c = F.regexp_replace(stem, r"(?i)^v?\d+(?:\.\d+)*[ _-]+", "")
    c = F.regexp_replace(c, r"[ _-]*\(?\d{4}[-_.]?\d{2}[-_.]?\d{2}\)?$", "")
    c = F.regexp_replace(c, r"(?i)^(?:draft|copy of|final)[ _-]+", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?i)[ _-]+(?:guide|manual|notes)$", ""), r"^[ _-]+|[ _-]+$", "")


def file_category(name: Column) -> Column:
    """A category from a file name: no suffix, no generic words, no digits and separators at its ends; 16 characters
    at most."""
    c = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"(?i)(?:document|file|guide|manual)", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(c, r"^[ _\-0-9]+|[ _\-0-9]+$", ""), 1, 16), F.lit("")), F.lit("other"))


def matched_terms(c: Column, terms) -> Column:
    """The terms, trimmed and distinct, that a text contains, in their order."""
    terms = [t.strip() for t in terms if t.strip()]
    return F.filter(F.array_distinct(F.array(*map(F.lit, terms))), lambda t: F.contains(c, t)) if terms else F.array().cast("array<string>")


def count_of(c: Column, term: Column) -> Column:
    """Occurrences of a term that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, term, F.lit("")))) / F.length(term)).cast("long")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\W+", "_")


def safe_double(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def canonical_hash(*columns: str) -> Column:
    """Hash of the named columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def duration_label(seconds: Column) -> Column:
    s = seconds.cast("long")
    hours, minutes = F.expr("1") * F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
    )


def json_object(c: Column, schema: str) -> Column:
    """The object between the first and last brace of a text, parsed; null if there is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def path_document_id(path: Column) -> Column:
    """doc- and 16 digits of the hash of a path in lower case, with slashes."""
    return F.concat(F.lit("doc-"), F.substring(F.sha1(F.lower(F.replace(path, F.lit("\\"), F.lit("/")))), 1, 16))


def automatic_document_id(base: Column, path: Column) -> Column:
    """doc- and 20 digits of the hash of a knowledge base and a path relative to it."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(base, F.lit(":"), F.lower(path)), 256), 1, 20))


def source_topics(stem: Column, text: Column, head: int = 1200) -> Column:
    """What a file speaks of, once each: terms quoted in its name, then at the head of its text, then its cleaned
    title if that has 2 to 24 characters and no quotes."""
    title = title_topic(stem)
    fits = F.length(title).between(2, 24) & ~title.rlike("[“”]")
    return F.array_distinct(F.concat(quoted_terms(stem), quoted_terms(F.substring(text, 1, head)), F.array_compact(F.array(F.when(fits, title)))))


def header_list(c: Column) -> Column:
    """The names in a comma-separated header: trimmed, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")))


def ideographic_name(c: Column) -> Column:
    """The Chinese characters of a text, 16 at most; empty if there are less than four."""
    kept = F.regexp_replace(c, r"[^\u4e00-\u9fff]", "")
    return F.when(F.length(kept) < 4, "").otherwise(F.substring(kept, 1, 16))


def subset_of(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
