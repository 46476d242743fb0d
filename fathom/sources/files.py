"""Files as documents, and JSON-lines logs."""

from __future__ import annotations

import csv
import io
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from fathom.functions.text import clean, strip
from fathom.session import cut
from fathom.sources import office
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes of plain files; those of office files are ``office.READERS``.
TEXT = ("txt", "csv")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = (*TEXT, *office.READERS)) -> DataFrame:
    """path, suffix, length, modified_at, file_hash, content (binary) of the files below the roots, each root once.

    Spark lists and reads the files, so any store will do; the order of rows isn't kept, and files of no bytes aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(dict.fromkeys(roots)))
    found = files.select("path", suffix(F.col("path")).alias("suffix"), "length", F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("file_hash"), "content")
    return found.where(F.col("suffix").isin(*suffixes))


# Encodings that a file is tried in where neither UTF-8 nor GB18030 fits, in this order.
OTHERS = ("utf-16-le", "utf-16-be", "big5", "euc_jp", "shift_jis", "euc_kr", "cp1252", "cp1251")
_BOMS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def _odd(text: str) -> float:
    """Share of characters that texts seldom have: controls, those without a meaning, and symbols between letters."""
    kinds = [unicodedata.category(c) for c in text if c not in "\t\r\n "]
    return sum(1.0 if k in ("Cc", "Cn", "Co", "Cs") else 0.3 if k[0] in "SM" else 0.0 for k in kinds) / max(1, len(kinds))


def _foreign(text: str, name: str) -> float:
    """Of two alphabets that use the same bytes: Latin with accents seldom has mostly other letters, Cyrillic has."""
    letters = [c for c in text if c.isalpha()]
    other = sum(not c.isascii() for c in letters) >= 0.5 * len(letters)
    return 0.1 * (other if name == "cp1252" else not other if name == "cp1251" else 0)


def detected(content: bytes, most: float = 0.2) -> str | None:
    """A text in GB18030 or in another of some encodings: one that its mark names, else the one whose pairs of bytes are
    all valid and make the fewest odd characters; none if all do."""
    for mark, name in _BOMS:
        if content.startswith(mark):
            try:
                return content.decode(name)
            except UnicodeDecodeError:
                return None
    try:
        return content.decode("gb18030")
    except UnicodeDecodeError:
        best = []
        for i, name in enumerate(OTHERS):
            # Texts of two bytes a character without a mark have zeros in one of both places, and others have none.
            zeros = (content[1::2].count(0), content[::2].count(0))
            wide = {"utf-16-le": zeros[0] > zeros[1], "utf-16-be": zeros[1] > zeros[0]}.get(name, not any(zeros))
            try:
                text = content.decode(name) if wide else ""
            except UnicodeDecodeError:
                continue
            if text:
                best.append((_odd(text[:100_000]) + _foreign(text[:100_000], name), i, text))
        return min(best)[2] if best and min(best)[0] <= most else None


def rows_of(text: str) -> str:
    """A table's rows as lines: cells trimmed, without blank ones, joined by `` | ``. A quoted cell may hold anything."""
    csv.field_size_limit(1 << 30)
    found = (" | ".join(c for c in map(str.strip, row) if c) for row in csv.reader(io.StringIO(text, newline=None)))
    return "\n".join(filter(None, found))


@F.pandas_udf(StringType())
def csv_records(text: pd.Series) -> pd.Series:
    """``rows_of`` whole files, quoted line ends among them."""
    return text.map(lambda x: None if x is None else rows_of(x)).astype(object)


def csv_text(text: Column) -> Column:
    """Cells of each row, trimmed and joined by `` | ``, without blank cells and rows. What has no quotes is split in the
    JVM; only files with quoted cells, whose line ends may be in a cell, take Python."""
    quoted = F.contains(text, F.lit('"'))
    return F.when(quoted, csv_records(F.when(quoted, text))).otherwise(_unquoted(text))


def _unquoted(text: Column) -> Column:
    plain = lambda line: F.array_join(F.filter(F.transform(F.split(line, ","), lambda c: strip(c)), lambda x: x != ""), " | ")
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n?|\n"), plain), lambda x: x != ""), "\n")


#: Characters of texts, or bytes of files, that go on at once; a larger one goes alone.
PORTION = 1_000_000


def _text(kind: str | None, valid: str | None, content: bytes | None) -> tuple[str | None, str | None, bool]:
    """The text of a file, what is wrong with it, and whether it is a table that is still to be taken apart."""
    if kind in office.READERS:
        try:
            return office.text_of(content, kind), None, False
        except office.LoadError as e:
            return None, str(e), False
    if kind not in TEXT:
        return None, "no reader for this kind", False
    text = detected(content) if valid is None and content is not None else valid
    if text is None:
        return None, "no encoding fits", False
    text = text.removeprefix("\ufeff")
    quoted = kind == "csv" and '"' in text
    return (rows_of(text) if quoted else text), None, kind == "csv" and not quoted


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("path", pa.string()), ("file_hash", pa.string()), ("content", pa.string()), ("error", pa.string()), ("table", pa.bool_())])
    for batch in batches:
        out, size = [], 0
        for row in zip(*batch.columns, strict=True):  # a file at a time: it may be large
            path, digest, *given = (x.as_py() for x in row)
            text, error, table = _text(*given)
            out.append({"path": path, "file_hash": digest, "content": text, "error": error, "table": table})
            size += len(text or "")
            if size > PORTION:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)


def read(files: DataFrame) -> DataFrame:
    """path, file_hash, content, error of all scanned files, one row each: the cleaned text, or what is wrong. A file that
    can't be read, whose suffix has no reader or that is blank where its kind mustn't be is an error, not a gap.

    Every file is listed, read and hashed once, whatever its kind. Python reads office files, decodes what isn't UTF-8 (as
    GB18030, a superset of GBK, or what a detector finds) and takes tables with quotes apart."""
    kind = F.col("suffix")
    valid = F.when(kind.isin(*TEXT), F.try_validate_utf8(F.col("content").cast("string")))
    given = files.select("path", "file_hash", "suffix", valid.alias("valid"), "content")
    left = F.when(F.col("valid").isNull() & kind.isin(*TEXT, *office.READERS), F.col("content"))
    said = given.select("path", "file_hash", "suffix", "valid", left.alias("content")).mapInArrow(_texts, "path string, file_hash string, content string, error string, table boolean")
    text = F.when(F.col("table"), _unquoted(F.col("content"))).otherwise(F.col("content"))
    return said.select("path", "file_hash", clean(text).alias("content"), "error")


def load(files: DataFrame) -> DataFrame:
    """path, file_hash, content (cleaned text) of scanned files; those without text go, and those that can't be read:
    ``read`` says which."""
    return read(files).where("error is null and content <> ''").select("path", "file_hash", "content")


def load_all(files: DataFrame) -> DataFrame:
    """The same, or an error: where a file can't be read, or where nothing has any text."""
    found = cut(read(files))
    wrong = found.where("error is not null").orderBy("path").select("path", "error").limit(5).collect()
    if wrong:
        raise office.LoadError("; ".join(f"{r['path']}: {r['error']}" for r in wrong))
    kept = found.where("content <> ''").select("path", "file_hash", "content")
    if kept.isEmpty():
        raise office.LoadError("no file has any text")
    return kept


def exists(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Whether each path is there, in any store that Spark reads."""
    out = {}
    for p in dict.fromkeys(paths):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        out[p] = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return out


def read_log(spark: SparkSession, path: str, schema: str, equal: dict | None = None, newest_by: str = "at", n: int = 200) -> DataFrame:
    """The newest n records of a JSON-lines log that have the given values; lines that aren't JSON are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(F.desc(newest_by)).limit(n)


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
