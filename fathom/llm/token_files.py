"""Token files: Parquet list columns of token ids, dictionary-encoded, with set row groups and page indexes.

A file set is a folder of Parquet files in ascending id order. Each row has its document's ids as a list
column beside its metadata, so a reader that wants only counts or some documents skips the id pages:
Parquet's column and offset indexes find pages by ``doc_id`` and column pruning leaves the rest unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import task, with_partition_offsets
from .tokens import encoder, portions

_FILE = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 64 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode whole texts and write them in ascending id order.

    Rows are dealt by range of (id, text, row), so rows that repeat an id, in any number, spread over files
    and stay in order. A null text is empty and has the end id alone; null ids come first; an empty table
    gives no rows. Other columns aren't read. The texts cross one shuffle and are encoded after it.
    """

    @task
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, total = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in portions(batch, 1, 8_000_000):
                ids, bounds = tok.encode_with_end(rows.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4")))
                columns = [rows.column(0), pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(total + bounds[:-1]), pa.array(np.diff(bounds)), lists]
                total += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    keys = ["doc_id", "_hash", "_row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    (
        ordered.mapInArrow(encode, _FILE)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file set: doc_id, start (ids of all documents before), n_tokens, ids.

    Starts come from the counts alone: one total a file, then a broadcast of as many rows as there are files."""
    rows = with_partition_offsets(spark.read.schema(_FILE).parquet(path), "part", "n_tokens", "_before")
    return rows.select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    @task
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            bounds = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
