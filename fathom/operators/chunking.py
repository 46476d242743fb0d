"""Chunking: windows, packed units, granularities and content-addressed identities."""

from __future__ import annotations

from fathom.functions.text import strip
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; an empty text has none."""
    step = size - overlap
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda s: F.substring(text, s + 1, F.lit(size)))


def window_count(text: Column, size: int, overlap: int) -> Column:
    """How many windows a text has."""
    return F.when(F.length(text) > 0, F.floor((F.length(text) - 1) / (size - overlap)) + 1).otherwise(0)


def fixed_windows(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """One row a window, as chunk_index (from 0) and chunk."""
    return docs.select(*docs.columns, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_index", "chunk")).drop(text)


def units(text: Column, heading: str) -> Column:
    """Section units: one begins at each line that starts with a heading."""
    return F.filter(F.transform(F.split(text, rf"\n(?={heading})"), strip), lambda x: x != "")


def packed(unit_array: Column, size: int = 600, overlap: int = 100) -> Column:
    """Units packed to chunks of about ``size`` characters.

    A unit joins the buffer while it fits; else the buffer is emitted and its last ``overlap`` characters are
    carried over. A unit longer than ``size`` is emitted as windows, and what was carried is given up; any
    other is added to the carried text without another check, so a chunk may be longer by the overlap."""
    empty = F.array().cast("array<string>")
    with_buffer = lambda acc: F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n"), b))
    carried = lambda acc: F.expr("''") if overlap == 0 else strip(F.right(acc["buf"], F.lit(overlap)))

    def step(acc: Column, unit: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(unit) + 1 <= size
        return (
            F.when(fits, F.struct(joined(acc["buf"], unit).alias("buf"), acc["out"].alias("out")))
            .when(F.length(unit) > size, F.struct(F.lit("").alias("buf"), F.concat(with_buffer(acc), windows(unit, size, overlap)).alias("out")))
            .otherwise(F.struct(joined(carried(acc), unit).alias("buf"), with_buffer(acc).alias("out")))
        )

    return F.aggregate(unit_array, F.struct(F.lit("").alias("buf"), empty.alias("out")), step, with_buffer)


def paragraphs(text: Column) -> Column:
    """Lines of four characters or more."""
    return F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)


def sentences(text: Column, end: str = ".!?") -> Column:
    """Pieces of three characters or more, cut behind each run's last terminator; newlines go first."""
    pieces = F.regexp_extract_all(F.replace(text, F.lit("\n"), F.lit("")), F.lit(f"[^{end}]*[{end}]|[^{end}]+"), F.lit(0))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: F.length(x) >= 3)


def identified(chunks: DataFrame, document: str, content: str, order: list[str], granularity: str | None = None, keep_content: bool = True) -> DataFrame:
    """chunk_hash and chunk_id (document::granularity::first 20 of the hash::ordinal of that hash). Without the
    content the hashes alone are moved for the ordinals."""
    hashed = chunks.withColumn("chunk_hash", F.sha2(F.trim(F.regexp_replace(content, r"\s+", " ")), 256))
    hashed = hashed if keep_content else hashed.drop(content)
    scope = [document, *([granularity] if granularity else []), "chunk_hash"]
    ordinal = F.lpad(F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("string"), 3, "0")
    kind = F.col(granularity) if granularity else F.lit("chunk")
    return hashed.withColumn("chunk_id", F.concat_ws("::", F.col(document), kind, F.substring("chunk_hash", 1, 20), ordinal))


def granularities(chunks: DataFrame, content: str = "chunk") -> DataFrame:
    """Each chunk as one row of granularity document, its paragraphs and its sentences, with their ordinals
    (taken after short ones are left out)."""
    rows = lambda kind, items: F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("granularity"), (i + 1).alias("ordinal"), x.alias("content")))
    every = F.concat(rows("document", F.array(content)), rows("paragraph", paragraphs(F.col(content))), rows("sentence", sentences(F.col(content))))
    return chunks.withColumn("_piece", F.explode(every)).select(*[c for c in chunks.columns if c != content], "_piece.*")
