"""Packing along a space-filling curve: documents near each other on a Hilbert curve share sequences.

A document's vector of hashed tokens is projected to three dimensions, its place on the Hilbert curve
through them is the sort key, and the ids of all documents, end to end along the curve, are cut into
sequences. Only the last sequence is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import task, with_partition_offsets, written
from .tokens import GENERATION, encoder, portions

DIMENSIONS, BITS, HASHED = 3, 10, 4096
#: Bytes of text that a worker encodes at once; with less it also gives memory back in between.
PORTION = 8_000_000


def projection(seed: int = 7) -> np.ndarray:
    """Random signs that take a count of hashed tokens to few dimensions."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(HASHED, DIMENSIONS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (n x dimensions, each under 2**bits).

    The usual transposition: undo the turns of each level from the top bit down, Gray-decode, interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray, signs: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Hilbert keys of documents whose ids lie end to end in ``ids``: mean of the projected hashed ids, in cells. Documents go
    in slices of about ``most`` ids, so what is made on the way stays small."""
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        own = bounds[at : to + 1] - bounds[at]
        hashed = (ids[bounds[at] : bounds[to]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)
        sums = np.stack([np.add.reduceat(signs[hashed, d], own[:-1]) for d in range(signs.shape[1])], axis=1)
        mean = sums / np.diff(own)[:, None]
        out.append(hilbert_key(np.clip(((mean + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)))
        at = to
    return np.concatenate(out)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    length: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    portion_bytes: int = PORTION,
    cached: int = GENERATION,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    Every id of every document, its end id included, lies in one piece; pieces fill sequences without gaps.
    A null text is empty (its end id alone); repeated rows are documents of their own; null ids are kept; an
    empty table gives no pieces. ``portion_bytes`` and ``cached``: bytes of text that a worker encodes at once and pieces that
    it remembers, which change its memory and time alone. Ties on the curve go by doc_id, then row, so any number of copies, which have
    one key, spread over range partitions. The running sums are exact over all rows: one within each range
    partition, one over the partitions' totals.
    """
    signs = projection()

    @task
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer, cached)
        for batch in batches:
            for rows in portions(batch, 2, portion_bytes, give_back=portion_bytes < PORTION):
                ids, bounds = tok.encode_with_end(rows.column(2), end_id)
                binary = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
                columns = [rows.column(0), rows.column(1), pa.array(curve_keys(ids, bounds, signs)), pa.array(np.diff(bounds)), binary]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "curve", "doc_tokens", "ids"])

    @task
    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = total + np.cumsum(sizes)
            if len(ends):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes), batch.column(1)], ["row", "part", "in_part", "doc_tokens"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = written(rows.mapInArrow(encode, "row long, doc_id long, curve long, doc_tokens long, ids binary"), "encoded")
    order = ["curve", "doc_id", "row"]
    along = encoded.select("row", "doc_tokens", *order[:2]).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(along.select("row", "doc_tokens").mapInArrow(running, "row long, part int, in_part long, doc_tokens long"), "placed")
    placed = with_partition_offsets(placed, "part", "doc_tokens", "_before").select("row", (F.col("_before") + F.col("in_part")).alias("place"))
    first, last = F.expr(f"place div {length}"), F.expr(f"(place + doc_tokens - 1) div {length}")
    pieces = (
        encoded.drop("curve")
        .join(placed, "row")
        .select("doc_id", "doc_tokens", "ids", "place", F.explode(F.sequence(first, last)).alias("sequence_id"))
        .withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("place")))
        .withColumn("length", F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * length - F.col("place")) - F.col("start"))
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        (F.col("place") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    )
