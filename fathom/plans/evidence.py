"""Queries of graph search and of the vector, graph and hybrid tools. Those of several steps that fold near copies
have no SQL; tests compare them with loops."""

from __future__ import annotations

from fathom.operators import evidence, governance, retrieval
from fathom.params import LATIN, RetrievalSettings
from fathom.session import cut
from fathom.sources import tables
from pyspark.sql import functions as F

from .registry import query

QUESTION = 'Which nation-3 suppliers are located in "region-1" near supplier-1?'
TERMS = ["the", "license", "eau"]
HINTS = ["located", "part of", "near", "owned"]
SETTINGS = RetrievalSettings(top_k=5, min_score=0.0, candidate_k=30)


def _units(spark, sf_dir):
    """Documents with a vector as units: fifty units or more share a document; even ones are paragraphs, most with a parent."""
    docs = tables.vectors(spark, sf_dir)
    group = F.concat(F.lit("grp-"), (F.col("doc_id") % 40).cast("string"))
    return docs.select(
        "doc_id",
        "embedding",
        "category",
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("chunk_id"),
        group.alias("document_id"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("up"), (F.col("doc_id") % 80).cast("string"))).alias("parent_chunk_id"),
        F.when(F.col("doc_id") % 2 == 0, "paragraph").otherwise("document").alias("granularity"),
        "source_file",
        "content",
    )


def _parents(units):
    return units.select(F.concat(F.lit("up"), F.col("doc_id").cast("string")).alias("chunk_id"), "document_id", F.lit("document").alias("granularity"), "source_file", "content")


def _allowed(spark, sf_dir, units):
    """Units that one reader may see, before anything is ranked."""
    rules = tables.access(tables.documents(spark, sf_dir))
    return units.join(governance.allowed(rules, "someone", ["r1", "r2"], []).select("doc_id"), "doc_id", "left_semi")


def _questions(spark, sf_dir, ids=(0, 3, 8)):
    vectors = tables.table(spark, sf_dir, "embeddings")
    return [vectors.where(F.col("vec_id") == i).select(F.col("embedding").alias("query")).limit(1) for i in ids]


def _vector_hits(spark, sf_dir, units):
    return evidence.vector_candidates(units, _questions(spark, sf_dir), "c3", ["token", "License", "the"], ["src0.txt"], SETTINGS.top_k, SETTINGS.candidates, SETTINGS.min_score)


def _edges(spark, sf_dir):
    text = lambda c: F.concat(F.col("source"), F.lit(c), F.col("target"))
    own = F.concat(F.lit("doc-"), (F.length("source") % 9).cast("string"))
    return tables.edges(spark, sf_dir).select("source", "label", "target", F.when(F.length("source") % 2 == 0, text(" lies in ")).otherwise("").alias("description"), text(" by ").alias("evidence"), "source_file", own.alias("document_id"), F.when(F.length("source") % 3 != 0, F.length("source") % 5 / 5.0).alias("confidence"))


_EDGES = """
link AS (
  SELECT 'nation-' || n_nationkey AS source, 'part of' AS label, 'region-' || n_regionkey AS target, 'nations.txt' AS source_file FROM nation
  UNION ALL SELECT 'supplier-' || s_suppkey, 'located in', 'nation-' || s_nationkey, 'suppliers.txt' FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey, 'located in', 'nation-' || c_nationkey, 'customers.txt' FROM customer),
edge AS (SELECT *, CASE WHEN length(source) % 2 = 0 THEN source || ' lies in ' || target ELSE '' END AS description, source || ' by ' || target AS evidence, 'doc-' || length(source) % 9 AS document_id,
  CASE WHEN length(source) % 3 <> 0 THEN length(source) % 5 / 5.0::DOUBLE END AS confidence FROM link)"""
_PATH = "source || ' -> ' || label || ' -> ' || target"


def _nodes(spark, sf_dir):
    ends = tables.edges(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.select("id", F.concat(F.lit("node "), "id").alias("text"))


def _entity_hits(spark, sf_dir):
    return tables.table(spark, sf_dir, "nation").where("n_nationkey < 6").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_nationkey") * 3 % 10 / 10.0).alias("score"))


def _relation_hits(spark, sf_dir):
    """Six relationships that are edges and some that aren't."""
    nation = tables.table(spark, sf_dir, "nation").where("n_nationkey < 9")
    key = F.col("n_nationkey").cast("string")
    return nation.select(F.concat(F.lit("nation-"), key).alias("source"), F.lit("part of").alias("label"), F.concat(F.lit("region-"), (F.col("n_regionkey") + F.when(F.col("n_nationkey") < 6, 0).otherwise(7)).cast("string")).alias("target"), F.concat(F.lit("said of "), key).alias("description"), (F.col("n_nationkey") * 7 % 11 / 11.0).alias("score"))


_LOCAL = f"""
hit AS (SELECT 'nation-' || n_nationkey AS id, n_nationkey * 3 % 10 / 10.0::DOUBLE AS score FROM nation WHERE n_nationkey < 6),
local AS (SELECT {_PATH} AS path, round(least(1, greatest(coalesce(a.score, 0), coalesce(b.score, 0), coalesce(confidence, 0.8))), 4) AS score, 'entity_vector' AS match_source FROM edge LEFT JOIN hit AS a ON a.id = source LEFT JOIN hit AS b ON b.id = target WHERE a.id IS NOT NULL OR b.id IS NOT NULL),
rel AS (SELECT 'nation-' || n_nationkey AS source, 'part of' AS label, 'region-' || (n_regionkey + CASE WHEN n_nationkey < 6 THEN 0 ELSE 7 END) AS target, 'said of ' || n_nationkey AS said, n_nationkey * 7 % 11 / 11.0::DOUBLE AS score FROM nation WHERE n_nationkey < 9),
global AS (SELECT {_PATH} AS path, round(rel.score, 4) AS score, 'relationship_vector' AS match_source, CASE WHEN edge.evidence IS NULL THEN said ELSE coalesce(nullif(description, ''), evidence) END AS description FROM rel LEFT JOIN edge USING (source, label, target))"""


@query(f"WITH {_EDGES}, {_LOCAL} SELECT path, score FROM local")
def graph_local_paths(spark, sf_dir):
    return evidence.local_paths(_entity_hits(spark, sf_dir), _edges(spark, sf_dir)).select("path", "score")


@query(f"WITH {_EDGES}, {_LOCAL} SELECT path, score, description FROM global")
def graph_global_paths(spark, sf_dir):
    """Relationship hits with what their edges say, or the hit itself."""
    return evidence.global_paths(_relation_hits(spark, sf_dir), _edges(spark, sf_dir)).select("path", "score", "description")


@query(f"""WITH {_EDGES}, {_LOCAL},
ranked AS (SELECT path, score, match_source, 0 AS stream, row_number() OVER (ORDER BY score DESC, path) AS pos FROM local UNION ALL SELECT path, score, match_source, 1, row_number() OVER (ORDER BY score DESC, path) FROM global),
one AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos, stream) AS n FROM ranked)
SELECT path, score, match_source, row_number() OVER (ORDER BY pos, stream) AS pos FROM one WHERE n = 1""")
def graph_mixed_paths(spark, sf_dir):
    found = evidence.mixed_paths(_entity_hits(spark, sf_dir), _relation_hits(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("path", "score", "match_source", "pos")


_NAMED = f"(contains('{QUESTION}', id) OR id = 'region-2' OR contains('node ' || id, 'supplier-1') OR contains('node ' || id, 'near'))"
_TEXT = "concat_ws(' ', source, label, target, description, evidence, source_file, document_id)"


@query(f"""WITH {_EDGES}, node AS (SELECT source AS id FROM edge UNION SELECT target FROM edge), named AS (SELECT id FROM node WHERE {_NAMED}),
s AS (SELECT {_PATH} AS path, confidence, (source IN (FROM named))::INT + (target IN (FROM named))::INT AS ends, contains({_TEXT}, 'supplier-1')::INT + contains({_TEXT}, 'near')::INT AS found FROM edge)
SELECT path, round(least(1, 0.5 * coalesce(confidence, 0.8) + 0.12 * ends + least(0.32, 0.08 * found)), 4)::DOUBLE AS score FROM s WHERE ends + found > 0""")
def graph_literal_paths(spark, sf_dir):
    """Edges by the words of the question, where no vector finds any."""
    return evidence.literal_paths(_nodes(spark, sf_dir), _edges(spark, sf_dir), QUESTION, "region-2", ["supplier-1", "near"]).select("path", "score")


@query(f"""WITH {_EDGES}, node AS (SELECT source AS id FROM edge UNION SELECT target FROM edge)
SELECT 'entity' AS kind, id AS keyword, FALSE AS fallback FROM node WHERE contains('{QUESTION}', id) OR id = 'region-2' UNION SELECT 'entity', 'region-1', FALSE
UNION SELECT 'relationship', label, FALSE FROM edge WHERE contains('{QUESTION}', label) OR contains(label, 'located') OR contains(label, 'near') UNION SELECT 'relationship', unnest(['located', 'near']), FALSE
UNION SELECT 'relationship', unnest(regexp_extract_all('{QUESTION}', '[A-Za-z0-9][A-Za-z0-9_-]+')), FALSE""")
def graph_query_keywords(spark, sf_dir):
    found = evidence.query_keywords(QUESTION, "region-2", _nodes(spark, sf_dir), _edges(spark, sf_dir), HINTS, LATIN.entities)
    return found.select("kind", "keyword", "fallback")


def _graph(spark, sf_dir, units):
    return evidence.graph_search(units, _nodes(spark, sf_dir), _edges(spark, sf_dir), _entity_hits(spark, sf_dir), _relation_hits(spark, sf_dir), QUESTION, "c3", TERMS, SETTINGS.top_k)


def _shown(hits):
    return hits.select("pos", "chunk_id", "document_id", F.round("score", 6).alias("score"), "matched_chunk_id", "matched_granularity", F.sha2("content", 256).alias("content_hash"))


@query()
def vector_tool(spark, sf_dir):
    """Three question vectors, access rules, parent context, near copies out, the first five."""
    units = cut(_allowed(spark, sf_dir, _units(spark, sf_dir)))  # several searches read them
    return _shown(evidence.vector_tool(_vector_hits(spark, sf_dir, units), _parents(units), SETTINGS.top_k, SETTINGS.dedup_threshold))


@query()
def graph_tool(spark, sf_dir):
    """Graph search with its chunks in parent context."""
    units = cut(_allowed(spark, sf_dir, _units(spark, sf_dir)))  # several searches read them
    return _shown(evidence.graph_tool(_graph(spark, sf_dir, units), _parents(units), SETTINGS.top_k, SETTINGS.dedup_threshold).chunks)


@query()
def hybrid_tool(spark, sf_dir):
    """Vector, graph and keyword streams in turn, parent context, near copies out, within the context budget."""
    units = cut(_allowed(spark, sf_dir, _units(spark, sf_dir)))  # several searches read them
    words = evidence.placed(retrieval.term_frequency_search(units, TERMS, SETTINGS.candidates, "chunk_id"), F.desc("score"), "chunk_id")
    found = evidence.hybrid_tool(_vector_hits(spark, sf_dir, units), _graph(spark, sf_dir, units), words, _parents(units), SETTINGS.top_k, SETTINGS.candidates, SETTINGS.dedup_threshold)
    return _shown(retrieval.fit_chunks(found.chunks, [], "pos", SETTINGS.max_context_tokens))
