"""Ranked lexical search by sort-based accumulation.

One pass over the documents keeps, for each, its number of terms and its counts of those terms that items ask for. A
second one goes through these in blocks: the arrays of matched (item, document, impact) are concatenated, their packed
keys are radix-sorted, ``numpy.add.reduceat`` adds up the impacts of a key, and a heap for each item keeps its best.
What the tasks kept is dealt by range of (item, score), where every part gives its best of each item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .decontam import words
from .shared import forget, only, task, written
from .tokens import portions

#: Bytes of a term: digits, letters in lower case, and all of non-ASCII characters; others end it.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """b: share in percent of a document's length that counts; pairs: (item, term) pairs sent to the tasks at once;
    matches: (item, document, impact) triples that a task sorts at once, at least one document's."""

    top_k: int = 10
    b: int = 75
    pairs: int = 1_000_000
    matches: int = 1_000_000


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and the sorted (text, place in the vocabulary, count) of those that it has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]].translate(_TERM_BYTES) if bounds[-1] > bounds[0] else b""
    lowered = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(data))
    cut = pc.split_pattern(lowered, " ")
    ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
    pieces = cut.flatten().dictionary_encode()
    codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return np.zeros(len(texts), np.int64), *([np.zeros(0, np.int64)] * 3)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    real = pc.not_equal(pieces.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    n = np.bincount(text[real], minlength=len(texts))
    place = pc.fill_null(pc.index_in(pieces.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    found = place >= 0
    key = np.sort(text[found] << 32 | place[found])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return n, key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """Order that sorts keys of 0 to ``most``: one stable pass for each 16 bits, the lowest first."""
    order = None
    for shift in range(0, max(1, int(most).bit_length()), 16):
        digit = (keys >> shift & 0xFFFF).astype(np.uint16)
        turn = np.argsort(digit if order is None else digit[order], kind="stable")  # NumPy sorts 16-bit keys by radix
        order = turn if order is None else order[turn]
    return order


@dataclass(frozen=True)
class _Block:
    """Items of one block: by term, where its items start in ``item`` and ``repeats``, and its weight."""

    start: np.ndarray
    item: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray
    items: int
    documents: int
    length: int


def accumulated(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, k: _Block, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, document, score of all pairs that share a term: matches by document, term and count, n by document."""
    m = 100 - b + b * n * k.documents // max(1, k.length)
    impact = k.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    each = k.start[term + 1] - k.start[term]
    match = np.repeat(np.arange(len(term)), each)
    at = np.arange(len(match)) + np.repeat(k.start[term] - (np.cumsum(each) - each), each)
    value, key = impact[match] * k.repeats[at], k.item[at] * len(n) + doc[match]
    if not len(key):
        return key, key, value
    order = radix_order(key, k.items * len(n))
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] // len(n), key[first] % len(n), np.add.reduceat(value, first)


class Best:
    """The ``k`` best (score, document) of each item, by a heap; equal scores by the lower id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, ids: list[int | None], doc: np.ndarray, score: np.ndarray) -> None:
        some = np.flatnonzero(score >= self.least[item])
        for i, d, x in zip(item[some].tolist(), doc[some].tolist(), score[some].tolist(), strict=True):
            own, heap = ids[d], self.heaps[i]
            entry = (x, own is not None, -(own or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for i, heap in enumerate(self.heaps):
            for x, known, own in heap:
                yield i, -own if known else None, x


def _counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id, n (its terms), terms, counts of each document; the sorted terms asked for go out once to each worker."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("search")
        vocabulary = pa.array(sent.value, pa.large_string())
        for batch in batches:
            for rows in portions(batch, 1):
                n, doc, term, tf = counted(rows.column(1), vocabulary)
                bounds = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, t)) for x, t in ((term, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def _frequencies(counts: DataFrame, size: int) -> DataFrame:
    """term, df: one row a term and task before the shuffle."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return counts.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _candidates(counts: DataFrame, block: _Block, s: Settings) -> DataFrame:
    """item (in the block), id, score: at most the k best of each item from every task."""
    sent = counts.sparkSession.sparkContext.broadcast(block)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("search")
        k: _Block = sent.value
        best, fan = Best(k.items, s.top_k), np.diff(k.start)
        for batch in batches:
            terms, counted = batch.column(2), batch.column(3)
            bounds = terms.offsets.to_numpy().astype(np.int64) - terms.offsets[0].as_py()
            term, tf = terms.flatten().to_numpy(zero_copy_only=False), counted.flatten().to_numpy(zero_copy_only=False)
            n, ids = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            total = np.concatenate([[0], np.cumsum(fan[term])])[bounds]
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(total, total[at] + s.matches, "right")) - 1)
                own = slice(bounds[at], bounds[to])
                doc = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
                item, d, score = accumulated(doc, term[own].astype(np.int64), tf[own], n[at:to], k, s.b)
                best.add(item, ids[at:to], d, score)
                at = to
        rows = list(best.rows())
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "id", "score"])

    return counts.mapInArrow(run, "item long, id long, score long")


def _leading(rows: DataFrame, k: int) -> DataFrame:
    """The best k of each item in every part of rows (row, id, score): dealt by range, so that an item's candidates
    spread over parts, however many tasks gave some."""
    order = [F.col("row"), F.desc("score"), F.asc_nulls_last("id")]

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            row = batch.column(0).to_numpy()
            if not len(row):
                continue
            new = np.concatenate([[row[0] != last], row[1:] != row[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(row)), -1))
            place = np.where(start >= 0, np.arange(len(row)) - start, np.arange(len(row)) + seen)
            last, seen = row[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < k))

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def rank(
    docs: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item id, rank (from 1), document id, score: each item's best documents with a score above 0.

    A term weighs floor(1000 ln((2N + 2) / (2df + 1))); its impact is that times the saturated count in the document,
    in integers. Terms that an item repeats count as often. Null and empty texts have no terms: such documents count
    in nothing, such items have no rows. Every row of either table is a document or item of its own, so repeated rows
    come out under one id with ranks of their own; null ids are kept, last among equal scores. Empty tables give no
    rows; other columns aren't read.

    Items go in blocks of about ``pairs`` (item, term) pairs, at least one item each; a block's terms are broadcast
    and the documents are read once a block. Every score is whole before anything is left out.
    """
    s, spark = settings, docs.sparkSession
    numbered = written(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "items")
    pairs = written(numbered.select("row", F.explode(words(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count("*").alias("repeats")), "pairs")
    texts, n_pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), pairs.count()
    blocks, kept = -(-n_pairs // s.pairs), []
    for i in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).toArrow()
        if not own.num_rows:
            continue
        terms = own["term"].combine_chunks().dictionary_encode()
        vocabulary, term = terms.dictionary.to_pylist(), terms.indices.to_numpy().astype(np.int64)
        rows, item = np.unique(own["row"].to_numpy(), return_inverse=True)
        order = np.lexsort((item, term))
        counts = written(_counts(texts, vocabulary), "counts")
        documents, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary))
        for r in _frequencies(counts, len(vocabulary)).collect():  # a row for each term of the block
            df[r["term"]] = r["df"]
        block = _Block(
            np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), item[order], own["repeats"].to_numpy()[order], np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64), len(rows), documents, length
        )
        names = F.broadcast(spark.createDataFrame(pa.table({"item": np.arange(len(rows)), "row": rows})))  # one row an item of the block
        some = written(_candidates(counts, block, s).join(names, "item").select("row", "id", "score"), "candidates")
        forget(counts)
        kept.append(_leading(some, s.top_k))
    if not kept:
        kept = [spark.createDataFrame([], "row long, id long, score long")]
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= s.top_k).join(numbered.select("row", "item"), "row")
    return best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
