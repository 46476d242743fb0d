"""Queries of chunking: windows, packed lines, granularities and identities."""

from __future__ import annotations

from fathom.functions.text import strip
from fathom.operators import chunking
from fathom.params import LATIN
from fathom.sources import tables
from pyspark.sql import functions as F

from .registry import query

_CHUNK = """
chunk AS (
  SELECT doc_id, 'doc-' || doc_id AS document_id, i AS chunk_index, substring(text, i * 500 + 1, 600) AS chunk
  FROM documents, LATERAL (SELECT unnest(range(0, (length(text) - 1) // 500 + 1)) AS i) WHERE length(text) > 0
)"""
_PIECES = rf"""{_CHUNK},
piece AS (
  SELECT document_id, chunk_index, 'document' AS granularity, 1 AS ordinal, chunk AS content FROM chunk
  UNION ALL
  SELECT document_id, chunk_index, 'paragraph', row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY i), x FROM (
    SELECT document_id, chunk_index, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM (
      SELECT *, list_filter(list_transform(regexp_split_to_array(chunk, '\n+'), lambda x: trim(x)), lambda x: length(x) >= 4) AS ps FROM chunk))
  UNION ALL
  SELECT document_id, chunk_index, 'sentence', row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY i), x FROM (
    SELECT document_id, chunk_index, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM (
      SELECT *, list_filter(list_transform(regexp_extract_all(replace(chunk, chr(10), ''), '[^.!?]*[.!?]|[^.!?]+'), lambda x: trim(x)), lambda x: length(x) >= 3) AS ss FROM chunk))
)"""
_HASH = r"sha256(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query(f"WITH {_CHUNK} SELECT doc_id, chunk_index, sha256(chunk) AS chunk_hash FROM chunk")
def fixed_windows(spark, sf_dir):
    return tables.chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("chunk", 256).alias("chunk_hash"))


@query()
def section_packing(spark, sf_dir):
    """Texts in sections at heading lines, packed to chunks of 600; the fold has no plain SQL, so tests compare
    it with a loop."""
    docs = tables.documents(spark, sf_dir)
    packed = chunking.packed(chunking.units(F.col("content"), LATIN.heading))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_index", "chunk"))


@query()
def line_packing(spark, sf_dir):
    """The same with lines as units."""
    lines = F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x != "")
    return tables.documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.packed(lines)).alias("chunk_index", "chunk"))


@query(f"WITH {_PIECES} SELECT document_id, chunk_index, ordinal, sha256(content) AS content_hash FROM piece WHERE granularity = 'paragraph'")
def paragraph_explode(spark, sf_dir):
    return _of(spark, sf_dir, "paragraph")


@query(f"WITH {_PIECES} SELECT document_id, chunk_index, ordinal, sha256(content) AS content_hash FROM piece WHERE granularity = 'sentence'")
def sentence_explode(spark, sf_dir):
    return _of(spark, sf_dir, "sentence")


def _pieces(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")
    return chunking.granularities(chunks).withColumn("ordinal", F.col("ordinal").cast("long"))


def _of(spark, sf_dir, kind):
    return _pieces(spark, sf_dir).where(F.col("granularity") == kind).select("document_id", "chunk_index", "ordinal", F.sha2("content", 256).alias("content_hash"))


@query(f"""WITH {_CHUNK}, hashed AS (SELECT *, {_HASH.format('chunk')} AS chunk_hash FROM chunk)
SELECT document_id, chunk_index, chunk_hash, document_id || '::chunk::' || substring(chunk_hash, 1, 20) || '::' || lpad(CAST(row_number() OVER (PARTITION BY document_id, chunk_hash ORDER BY chunk_index) AS VARCHAR), 3, '0') AS chunk_id FROM hashed""")
def chunk_identity(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")
    return chunking.identified(chunks, "document_id", "chunk", ["chunk_index"]).drop("chunk")


@query(f"""WITH {_PIECES}, hashed AS (SELECT *, {_HASH.format('content')} AS chunk_hash FROM piece)
SELECT document_id, granularity, chunk_index, ordinal, document_id || '::' || granularity || '::' || substring(chunk_hash, 1, 20) || '::'
  || lpad(CAST(row_number() OVER (PARTITION BY document_id, granularity, chunk_hash ORDER BY chunk_index, ordinal) AS VARCHAR), 3, '0') AS chunk_id FROM hashed""")
def multi_granularity_ids(spark, sf_dir):
    found = chunking.identified(_pieces(spark, sf_dir), "document_id", "content", ["chunk_index", "ordinal"], "granularity", keep_content=False)
    return found.select("document_id", "granularity", "chunk_index", "ordinal", "chunk_id")
