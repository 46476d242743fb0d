"""Language identification by Bloom filters over character n-grams, bit-sliced: one filter for each language.

All languages' filters share their places, so a place holds a bit mask of languages, and the AND of the masks at an
n-gram's places says at once which languages hold it. A text's n-grams are counted for each language, the count is
corrected for the filter's share of false positives, and the language with the largest share of the n-grams wins.

A language holds an n-gram that is about as frequent in its texts as in those of any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, only, task, written
from .tokens import portions

#: Mixes code points into one hash, and that into the filter's places: odd numbers of 64 bits.
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_LETTERS: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Settings:
    """n: letters of an n-gram, with a space at either end of a word; max_rows: documents of a language that are learned
    from at most; share: of its highest rate in any language that an n-gram must have to be held; least: how often it must
    have been seen; hashes and fill: places of an n-gram, and share of a filter's bits that may be set;
    slice_bits: places of the filters that one task builds."""

    n: int = 3
    max_rows: int = 4000
    share: float = 0.25
    least: int = 3
    hashes: int = 4
    fill: float = 0.5
    slice_bits: int = 16


@dataclass(frozen=True)
class Filters:
    """languages in bit order; bits: places x bytes, a mask each; fill: share of set bits by language; usual: place of
    the language with most documents."""

    languages: tuple[str, ...]
    bits: np.ndarray
    fill: np.ndarray
    usual: int
    n: int
    hashes: int


def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    if "letters" not in _LETTERS:
        _LETTERS["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS["letters"]


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of all n-grams of the lower-case words, a space at either end included (a word of
    fewer than n - 2 letters has none); whether each text has a letter."""
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(x == 10)
    is_letter = _letters()[x]
    has = np.zeros(len(texts), bool)
    has[text[is_letter]] = True
    # Runs of others become one space, which is kept behind a letter and before one.
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    kept = np.concatenate([[True], kept])
    code = np.concatenate([[0], np.where(is_letter, x, 0)])[kept].astype(np.uint64)
    text = np.concatenate([[0], text])[kept]
    size = len(code) - n + 1
    if size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), has
    with np.errstate(over="ignore"):
        h, inner = np.zeros(size, np.uint64), np.zeros(size, bool)
        for i in range(n):
            h = (h ^ code[i : i + size]) * _ODD[0]
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inner |= code[i : i + size] == 0
        h = (h ^ h >> np.uint64(32)) * _ODD[1]
    # A space inside would join two words; one at the start may stand for the end of the text before.
    own = np.where(code[:size] == 0, np.append(text[1:], text[-1])[:size], text[:size])
    return own[~inner], h[~inner], has


def _places(h: np.ndarray, hashes: int, places: int) -> Iterator[np.ndarray]:
    for i in range(hashes):
        with np.errstate(over="ignore"):
            yield (h * _ODD[1 + i] >> np.uint64(32)).astype(np.int64) * places >> 32


def learn(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of all languages in ``docs``, learned from a sample of each by a hash of the id: at most about
    ``max_rows`` documents of a language, whose texts are read whole by as many tasks as there are.

    Rows without id, text or language are left out; rows that repeat an id and language count once. N-grams are
    counted by a shuffle with partial sums. The driver gets one row a language and the filters, whose size follows
    from the sample's n-grams. No rows give no languages.
    """
    s, spark = settings, docs.sparkSession
    if not 1 <= s.hashes < len(_ODD):
        raise ValueError(f"1 to {len(_ODD) - 1} hashes")
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sizes = marked.select("lang").groupBy("lang").count().orderBy("lang").collect()  # one row a language
    languages = tuple(r["lang"] for r in sizes)
    if not languages:
        return Filters((), np.zeros((1, 1), np.uint8), np.zeros(0), 0, s.n, s.hashes)
    cuts = [(r["lang"], i, round(min(1.0, s.max_rows / r["count"]) * (1 << 30))) for i, r in enumerate(sizes)]
    cuts = F.broadcast(spark.createDataFrame(cuts, "lang string, number int, cut long"))
    chosen = marked.join(cuts, "lang").where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.col("cut"))
    sample = chosen.groupBy("id", "number").agg(F.min("text").alias("text")).select("number", "text")

    @task
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language", _LETTERS)
        for batch in batches:
            for rows in portions(batch, 1):
                at, h, _ = grams(rows.column(1).to_pylist(), s.n)
                number = rows.column(0).to_numpy()[at]
                for own in np.unique(number):
                    found, n = np.unique(h[number == own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), own, np.int32)), pa.array(n.astype(np.int64))], ["gram", "number", "n"])

    counted = written(sample.mapInArrow(count, "gram long, number int, n long").groupBy("gram", "number").agg(F.sum("n").alias("n")), "grams")
    rates = counted.join(F.broadcast(counted.groupBy("number").agg(F.sum("n").alias("all"))), "number").select("gram", "number", "n", (F.col("n") / F.col("all")).alias("rate"))
    each = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("number", "n", "rate")).alias("each")).select("gram", "most", F.explode("each").alias("e"))
    held = written(each.where((F.col("e.rate") >= s.share * F.col("most")) & (F.col("e.n") >= s.least)).select("gram", F.col("e.number").alias("number")), "held")
    most = max([1, *(r["count"] for r in held.groupBy("number").count().collect())])
    bits = max(s.slice_bits, math.ceil(math.log2(s.hashes * most / -math.log1p(-s.fill))))
    places, width, low = 1 << bits, -(-len(languages) // 8), (1 << s.slice_bits) - 1

    @task
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(1)
            for at in _places(batch.column(0).to_numpy().view(np.uint64), s.hashes, places):
                yield pa.RecordBatch.from_arrays([pa.array((at >> s.slice_bits).astype(np.int32)), pa.array((at & low).astype(np.int32)), number], ["slice", "place", "number"])

    def build(group: pa.Table) -> pa.Table:
        own = np.zeros((low + 1, width), np.uint8)
        number = group["number"].to_numpy()
        np.bitwise_or.at(own, (group["place"].to_numpy(), number >> 3), (1 << (number & 7)).astype(np.uint8))
        return pa.table({"slice": group["slice"].slice(0, 1), "bits": pa.array([own.tobytes()], pa.binary())})

    masks = np.zeros((places, width), np.uint8)
    for r in held.mapInArrow(spread, "slice int, place int, number int").groupBy("slice").applyInArrow(build, "slice int, bits binary").toLocalIterator():
        masks[r["slice"] << s.slice_bits : (r["slice"] + 1) << s.slice_bits] = np.frombuffer(r["bits"], np.uint8).reshape(-1, width)
    forget(counted, held)
    fill = np.array([(masks[:, i >> 3] >> (i & 7) & 1).mean() for i in range(len(languages))])
    return Filters(languages, masks, fill, int(np.argmax([r["count"] for r in sizes])), s.n, s.hashes)


def shares(texts: list[str | None], f: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Share of each text's n-grams (rows) that each language (columns) holds, without the false positives that its
    filter's fill makes likely; whether each text has a letter."""
    text, h, has = grams(texts, f.n)
    mask = None
    for at in _places(h, f.hashes, len(f.bits)):
        mask = f.bits[at] if mask is None else mask & f.bits[at]
    n, ones = np.bincount(text, minlength=len(texts)), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    hits = [np.bincount(text * 256 + column, minlength=256 * len(texts)).reshape(-1, 256) @ ones.astype(np.int64) for column in mask.T]
    false = f.fill**f.hashes
    share = np.concatenate(hits, axis=1)[:, : len(f.languages)] / np.maximum(n, 1)[:, None]
    return np.clip((share - false) / np.maximum(1 - false, 1e-9), 0.0, 1.0), has


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of each whole text, and the share of its n-grams that the language holds (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as all are where no language was learned; a
    text of unknown n-grams alone gets the language with most documents and score 0; ties go to the first language
    by name. All rows and columns stay; columns named like the new ones are replaced. No shuffle: the filters go
    out once to each worker.
    """
    docs = docs.drop(out, score)
    rows = docs.select("*", F.col(f"`{text_col}`").cast("string")).toDF(*[f"c{i}" for i in range(len(docs.columns) + 1)])  # names with dots, too
    sent, docs_names = docs.sparkSession.sparkContext.broadcast(filters), docs.columns

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language", _LETTERS)
        f = sent.value
        names = np.array([*f.languages, "und"], dtype=object)
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                held, has = shares(texts, f) if f.languages else (np.zeros((len(texts), 1)), np.zeros(len(texts), bool))
                best = np.where(held.max(axis=1) > 0, held.argmax(axis=1), f.usual)
                best, points = np.where(has, best, len(f.languages)), np.where(has, held[np.arange(len(texts)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[best], pa.string()), pa.array(points, pa.float64())], [*docs_names, out, score])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]))
