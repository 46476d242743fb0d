"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of consecutive k-gram hashes keeps its least hash. A span of ``window`` words holds
``window - k + 1`` k-grams, one full window, so documents and benchmark keep the same hash of any span that
they share: none is missed. Kept hashes are joined, and each hit is extended to the windows of words around
it, which are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A fingerprint holds the hash in the high bits and the place of its k-gram in the low ones.
_PLACE = (1 << 28) - 1
_HIT = "array<struct<start:int,length:int>>"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased and no other letters; runs of ASCII letters, digits and non-ASCII.
    ``lower`` does just that to text that is ASCII throughout, much faster than ``translate``."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _upto(last: Column, item) -> Column:
    """item(i) for i from 0 to last, none where last is negative."""
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), item)


def _grams(k: int, length: int) -> Column:
    """Fingerprints of all k-grams in the column hs of word hashes; spans of different lengths hash apart."""
    hashed = lambda i: F.xxhash64(F.slice("hs", i + 1, k), F.lit(length))
    return _upto(F.size("hs") - k, lambda i: hashed(i).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))


def _least(w: int) -> Column:
    """Winnowing: the distinct least fingerprints over windows of w fingerprints in the column grams."""
    return F.array_distinct(_upto(F.size("grams") - w, lambda i: F.array_min(F.slice("grams", i + 1, w))))


def _key(fingerprint: Column) -> Column:
    return F.shiftrightunsigned(fingerprint, 28)


def _span(start: Column, length) -> Column:
    return F.concat_ws(" ", F.slice("ws", start + 1, length))


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_broadcast_windows: int = 1_000_000,
) -> DataFrame:
    """One row a document: id, text_hash, n_words, n_hit, items (sorted ids), spans (merged word spans), contaminated.

    A window is ``window`` consecutive item words; an item of fewer words is one window whole. A document word
    inside any occurrence of a window is hit; an item counts once if a window of it occurs. Null and empty
    texts have no words and no hits. Repeated rows come out as often as they came in; a null id is a value
    like others; an item without id counts under the empty id. Empty tables give no rows or no hits.

    The benchmark's fingerprints and windows are broadcast, in blocks of at most ``max_broadcast_windows``
    windows each; documents are read once a block and move as hits alone, one shuffle by document.
    """
    spark, w = docs.sparkSession, window - k + 1
    item = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("ws")).where(F.size("ws") > 0)
    n = F.size("ws")
    spans = item.select("item", F.explode(_upto(F.greatest(F.lit(0), n - window), lambda i: F.struct(i.alias("start"), F.least(n, F.lit(window)).alias("length")))).alias("at"), "ws")
    windows = written(spans.select("item", F.col("at.length").alias("length"), _span(F.col("at.start"), F.col("at.length")).alias("span")).distinct(), "windows")
    blocks = max(1, -(-windows.count() // max_broadcast_windows))
    lengths = sorted(r["length"] for r in windows.where(F.col("length") < window).select("length").distinct().collect())  # at most window - 1

    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("ws"))
    hashed = hashed.withColumn("n_words", F.size("ws").cast("long")).withColumn("hs", F.transform("ws", lambda x: F.xxhash64(x)))
    kept = F.concat(_least(w), *[_grams(length, length) for length in lengths]) if lengths else _least(w)
    printed = hashed.withColumn("grams", _grams(k, window)).withColumn("kept", kept)

    parts = []
    for block in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("span"), F.lit(blocks)) == block) if blocks > 1 else windows
        spans = own.groupBy("span").agg(F.collect_set("item").alias("items"))
        each = own.select("length", F.split("span", " ").alias("ws")).distinct().withColumn("hs", F.transform("ws", lambda x: F.xxhash64(x)))
        full = each.where(F.col("length") == window).withColumn("grams", _grams(k, window)).select("length", F.explode(_least(w)).alias("f"))
        prints = full.select(_key(F.col("f")).alias("key"), "length")
        for length in lengths:
            whole = each.where(F.col("length") == length).select("length", F.explode(_grams(length, length)).alias("f"))
            prints = prints.unionByName(whole.select(_key(F.col("f")).alias("key"), "length"))
        prints = prints.distinct()
        # A null fingerprint stands for the document itself, so that those without hits stay.
        header = F.array(F.lit(None).cast("long")) if block == 0 else F.array().cast("array<long>")
        rows = printed.select("id", "text_hash", "n_words", "ws", F.explode(F.concat(header, "kept")).alias("f"))
        hit = rows.join(F.broadcast(prints), _key(F.col("f")) == F.col("key"), "left").where(F.col("f").isNull() | F.col("key").isNotNull())
        at = F.col("f").bitwiseAND(F.lit(_PLACE)).cast("int")
        first = F.when(F.col("length") == window, F.greatest(F.lit(0), at - (w - 1))).otherwise(at)
        last = F.least(at, F.col("n_words").cast("int") - F.col("length"))
        around = F.transform(F.when(last >= first, F.sequence(first, last)), lambda s: F.struct(s.alias("start"), F.col("length").alias("length"), _span(s, F.col("length")).alias("span")))
        tried = hit.select("id", "text_hash", "n_words", F.col("f").isNull().alias("header"), F.explode_outer(F.when(F.col("f").isNotNull(), around)).alias("t"))
        tried = tried.select("id", "text_hash", "n_words", "header", "t.start", "t.length", "t.span")
        found = tried.join(F.broadcast(spans), "span", "left").where(F.col("header") | F.col("items").isNotNull())
        parts.append(found.select("id", "text_hash", "n_words", "header", F.when(F.col("items").isNotNull(), F.struct("start", "length")).alias("at"), "items"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    by_doc = hits.groupBy("id", "text_hash", "n_words").agg(
        F.count_if("header").cast("int").alias("copies"), F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    empty = F.struct(F.array().cast(_HIT).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    closed = lambda acc: F.when(acc["end"] > acc["start"], F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), (acc["end"] - acc["start"]).alias("length"))))).otherwise(acc["done"])
    merge = lambda acc, x: F.when(
        x["start"] <= acc["end"], F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], x["start"] + x["length"]).alias("end"))
    ).otherwise(F.struct(closed(acc).alias("done"), x["start"].alias("start"), (x["start"] + x["length"]).alias("end")))
    merged = by_doc.withColumn("spans", F.aggregate("at", empty, merge, closed)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return merged.select(F.col("id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that share no window with the benchmark, all their columns as they were.

    Null and empty texts share nothing and stay, as do repeated rows and rows with a null id; an empty benchmark
    leaves all. A caller's columns may have any names. The ids of the others are written first, so their
    measured size decides between broadcast and shuffle."""
    found = report(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    key, digest = unused("id", docs), unused("hash", docs)
    bad = written(found.select(F.col(id_col).alias(key), F.col("text_hash").alias(digest)).distinct(), "contaminated")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(digest)), "left_anti")
