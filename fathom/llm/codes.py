"""Vector code compression: product quantisation with integer arithmetic, trained by a reduction tree.

Vectors become integers and are packed into blocks, columnar NumPy arrays of one dimension after the other. Each round
is one ``treeAggregate`` over the blocks: a task adds up squared distances to all entries dimension by dimension,
counts and sums the parts of each entry with ``np.add.at``, and the int64 tensors merge through the tree, so the driver
gets a few tensors of a fixed size however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, with_classes, written

#: Components up to this size have squared distances that fit in 64 bits for parts of up to 128 dimensions.
_NARROW, _WIDEST_PART = 1 << 27, 128


@dataclass(frozen=True)
class Settings:
    """scale: what a component is multiplied with before it is rounded down; block_rows: vectors in a block at most;
    chunk: vectors whose distances a task holds at once; depth: of the reduction tree."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block_rows: int = 4096
    chunk: int = 1024
    depth: int = 3


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Components (dimensions x rows) rounded down, as int64, or as Python integers where one needs more."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max(initial=0) <= _NARROW:
        out = y.astype(np.int64)
    else:  # a product beyond the doubles' range is taken in integers
        out = np.array([[int(np.floor(v)) if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in r] for r in x], dtype=object).reshape(x.shape)
        big = np.abs(x) >= 2.0**52  # such a double is an integer, and so is its product
        out[big] *= scale
    pad = np.zeros((dims - out.shape[1], len(column)), dtype=out.dtype)
    return np.ascontiguousarray(np.concatenate([out.T, pad]))


def _pack(x: np.ndarray) -> tuple[bool, bytes]:
    if x.dtype != object:
        return False, x.astype("<i8").tobytes()
    return True, "\n".join(map(str, x.ravel())).encode()


def _unpack(wide: bool, data: bytes, dims: int) -> np.ndarray:
    if not wide:
        return np.frombuffer(data, "<i8").reshape(dims, -1)
    return np.array([int(v) for v in data.split()], dtype=object).reshape(dims, -1)


def _kind(x: np.ndarray, books: np.ndarray) -> type:
    """int32 where no squared distance overflows it, else int64, else Python integers."""
    if x.dtype == object or books.dtype == object:
        return object
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    width = books.shape[1]
    if most > _NARROW or width > _WIDEST_PART:
        return object
    return np.int32 if width * (2 * most) ** 2 < 1 << 31 else np.int64


def nearest(part: np.ndarray, book: np.ndarray, kind: type, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry (of ``book``, dimensions x entries) nearest to each column of ``part``, ties to the lower, and the squared
    distance; distances accumulate dimension by dimension."""
    part, book = part.astype(kind), book.astype(kind)
    index, error = [], []
    for at in range(0, part.shape[1], chunk):
        block = part[:, at : at + chunk]
        total = np.zeros((block.shape[1], book.shape[1]), dtype=kind)
        for x, c in zip(block, book, strict=True):
            apart = x[:, None] - c[None, :]
            total += apart * apart
        best = total.argmin(axis=1)
        index.append(best)
        error.append(total[np.arange(len(best)), best])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *index]).astype(np.int64), np.concatenate([none.astype(object if kind is object else np.int64), *error])


def _sums(x: np.ndarray, books: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x dimensions x entries) and counts (parts x entries) of a block's parts by nearest entry."""
    kind = _kind(x, books)
    sums, counts = np.zeros(books.shape, dtype=object if kind is object else np.int64), np.zeros((books.shape[0], books.shape[2]), np.int64)
    for p, part in enumerate(np.split(x, books.shape[0])):
        index, _ = nearest(part, books[p], kind, chunk)
        np.add.at(counts[p], index, 1)
        for d, values in enumerate(part):
            np.add.at(sums[p, d], index, values)
    return sums, counts


def _merged(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book.T for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: id, code (two hex digits a part), error, label, label_error, codebooks_sha256.

    Vectors that are null, empty or hold null or non-finite components are dropped. The codebooks start at the
    vectors of the smallest ids (null ids last, equal ids by their components); with fewer vectors than entries
    there are as many entries as vectors. Repeated rows are vectors of their own. The dimension is that of the
    smallest id; vectors of another have no place in these codebooks and are dropped, too. A dimension that the
    parts don't divide is filled with zeros. Errors that a long can't hold are null. Labels that are equal, or
    null, share label_error. An empty table gives no rows; other columns aren't read.
    """
    s, spark = settings, vectors.sparkSession
    if not 1 <= s.entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    sure = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size("v") > 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.where(sure)
    label_type = rows.schema["label"].dataType
    codes = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label", label_type)])
    # Of one id by the vector, so that the same rows give the same codebooks.
    smallest = lambda some, n: some.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(n).collect()
    first = smallest(rows, s.entries)
    if not first:
        empty = spark.createDataFrame([], codes)
        return empty.select(F.col("id").alias(id_col), "code", "error", "label", F.col("error").alias("label_error"), F.lit(digest(np.zeros((0, 0, 0)))).alias("codebooks_sha256"))
    size = len(first[0]["v"])
    dims, rows = -(-size // s.parts) * s.parts, rows.where(F.size("v") == size)
    if any(len(r["v"]) != size for r in first):
        first = smallest(rows, s.entries)
    start = pa.array([r["v"] for r in first], pa.list_(pa.float64()))
    books = np.stack(np.split(_integers(start, dims, s.scale), s.parts))

    block_type = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_type)), T.StructField("wide", T.BooleanType()), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, s.block_rows):
                some = batch.slice(at, s.block_rows)
                wide, data = _pack(_integers(some.column(1), dims, s.scale))
                bounds = pa.array([0, some.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, some.column(c)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([wide]), pa.array([data], pa.binary())], ["ids", "labels", "wide", "data"])

    blocks = written(rows.mapInArrow(pack, block_type), "blocks")
    parts = blocks.select("wide", "data").rdd
    for _ in range(s.rounds):
        sent = spark.sparkContext.broadcast(books)

        def add(total, block, sent=sent):
            return _merged(total, _sums(_unpack(block[0], block[1], dims), sent.value, s.chunk))

        sums, counts = parts.treeAggregate(None, add, _merged, depth=s.depth)
        used = counts > 0
        books = np.where(used[:, None, :], sums // np.maximum(counts, 1)[:, None, :], books)
    final, name = spark.sparkContext.broadcast(books), digest(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpack(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), dims)
                kind, found = _kind(x, final.value), np.zeros((s.parts, x.shape[1]), np.uint8)
                total = np.zeros(x.shape[1], object if kind is object else np.int64)
                for p, part in enumerate(np.split(x, s.parts)):
                    found[p], error = nearest(part, final.value[p], kind, s.chunk)
                    total += error
                text = np.ascontiguousarray(found.T).tobytes().hex()
                code = [text[j : j + 2 * s.parts] for j in range(0, len(text), 2 * s.parts)]
                errors = pa.array([None if e >= 1 << 63 else e for e in total.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(code, pa.string()), errors, batch.column(1)[i].values], ["id", "code", "error", "label"])

    # An array holds a null label like any other, so nulls meet, too.
    coded = written(blocks.mapInArrow(encode, codes).withColumn("key", F.array("label")), "codes")
    forget(blocks)
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when((F.count("*") == F.count("error")) & (whole <= F.lit((1 << 63) - 1).cast("decimal(38,0)")), whole.cast("long"))
    out = with_classes(coded, written(coded.groupBy("key").agg(fits.alias("label_error")), "label-errors"), "key")
    return out.select(F.col("id").alias(id_col), "code", "error", "label", "label_error", F.lit(name).alias("codebooks_sha256"))
