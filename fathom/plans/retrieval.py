"""Queries of retrieval: vector and keyword search, fusion, de-duplication, context."""

from __future__ import annotations

from fathom.functions import text as T
from fathom.functions.vectors import cosine
from fathom.operators import chunking, governance, retrieval
from fathom.params import LATIN
from fathom.sources import tables
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import query

ENTITIES, FILES, TERMS = ["token", "License", "the"], ["src0.txt", "src3.txt"], ["the", "license", "eau"]

_VEC = """
vec AS (
  SELECT d.doc_id, d.text, d.source || '.txt' AS source_file, 'c' || e.label AS category,
    greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) AS v
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
)"""
_SCORED = """
near AS (SELECT * FROM {rows} ORDER BY v DESC, doc_id LIMIT 50),
scored AS (
  SELECT doc_id, v, 0.65 * v + 0.20 * (category = 'c3')::INT + 0.10 * (contains(text, 'token')::INT + contains(text, 'License')::INT + contains(text, 'the')::INT) / 3.0
    + 0.05 * (source_file IN ('src0.txt', 'src3.txt'))::INT AS s FROM near
)"""


def _query_vector(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query")).limit(1)


def _search(spark, sf_dir, rows, **options):
    found = retrieval.vector_search(rows, _query_vector(spark, sf_dir), "c3", ENTITIES, FILES, candidate_k=50, **options)
    return found.select("doc_id", F.round("vector_score", 6).alias("vector_score"), F.round("score", 6).alias("score"))


@query(f"WITH {_VEC}, {_SCORED.format(rows='vec')} SELECT doc_id, round(v, 6) AS vector_score, round(s, 6) AS score FROM scored WHERE s >= 0.0")
def vector_topk_scored(spark, sf_dir):
    return _search(spark, sf_dir, tables.vectors(spark, sf_dir), min_score=0.0)


@query(f"WITH {_VEC}, ok AS (SELECT * FROM vec WHERE doc_id % 3 <> 0 OR doc_id % 5 IN (1, 2)), {_SCORED.format(rows='ok')} SELECT doc_id, round(v, 6) AS vector_score, round(s, 6) AS score FROM scored WHERE s >= 0.0")
def vector_topk_acl(spark, sf_dir):
    docs = tables.vectors(spark, sf_dir)
    allowed = governance.allowed(tables.access(tables.documents(spark, sf_dir)), "someone", ["r1", "r2"], [])
    return _search(spark, sf_dir, docs.join(allowed.select("doc_id"), "doc_id", "left_semi"), min_score=0.0)


@query(f"WITH {_VEC}, {_SCORED.format(rows='vec')} SELECT doc_id, round(v, 6) AS vector_score, round(s, 6) AS score FROM scored WHERE s >= 0.25")
def vector_min_score_filter(spark, sf_dir):
    return _search(spark, sf_dir, tables.vectors(spark, sf_dir), min_score=0.25)


@query("SELECT doc_id, (contains(text, 'token')::INT + contains(text, 'License')::INT + contains(text, 'the')::INT) / 3.0::DOUBLE AS entity_score FROM documents")
def entity_match_score(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return docs.select("doc_id", retrieval.entity_score(F.col("content"), ENTITIES).alias("entity_score"))


@query("""
SELECT label, vec_id, round(v, 6) AS score, rank FROM (
  SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY v DESC, vec_id) AS rank FROM (
    SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS v FROM embeddings))
WHERE rank <= 5""")
def graph_vector_topk(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings").join(F.broadcast(_query_vector(spark, sf_dir)))
    scored = rows.select("label", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("v"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "vec_id")))
    return ranked.where("rank <= 5").select("label", "vec_id", F.round("v", 6).alias("score"), "rank")


@query("""
SELECT doc_id, round(s, 6)::DOUBLE AS score FROM (
  SELECT d.doc_id, 0.45 + 0.2 * (e.label = 3)::INT + least(0.3, 0.08 * (contains(text, 'the')::INT + contains(text, 'license')::INT + contains(text, 'eau')::INT)) + 0.05 * (source IN ('src0', 'src3'))::INT AS s
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) ORDER BY s DESC, doc_id LIMIT 50""")
def keyword_category_score(spark, sf_dir):
    found = retrieval.keyword_category_search(tables.vectors(spark, sf_dir), "c3", TERMS, FILES, 50, "doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


_HITS = " + ".join(f"(length(text) - length(replace(text, '{t}', ''))) // {len(t)}" for t in TERMS)


@query(f"SELECT doc_id, CAST(hits AS BIGINT) AS hits, round(least(1.0, 0.35 + 0.08 * hits), 6)::DOUBLE AS score FROM (SELECT doc_id, {_HITS} AS hits FROM documents) WHERE hits > 0 ORDER BY least(1.0, 0.35 + 0.08 * hits) DESC, doc_id LIMIT 100")
def keyword_term_frequency(spark, sf_dir):
    found = retrieval.term_frequency_search(tables.documents(spark, sf_dir), TERMS, 100, "doc_id")
    return found.select("doc_id", "hits", F.round("score", 6).alias("score"))


@query("SELECT item_id, array_to_string(list_transform(list_filter(list_zip(ts, range(1, len(ts) + 1)), lambda x: list_position(ts, x[1]) = x[2]), lambda x: x[1]), ' ') AS tokens FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM benchmark)")
def query_tokens(spark, sf_dir):
    return tables.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


def _hits(spark, sf_dir):
    """Chunks as hits: a question is a language, the place is that of the chunk in the corpus, the score derives from length."""
    chunks = tables.chunks(spark, sf_dir)
    score = (F.length("chunk") * 7 + F.col("doc_id") * 13 + F.col("chunk_index") * 3) % 101 / 100
    pos = F.col("doc_id") * 1_000_000 + F.col("chunk_index")
    return chunks.select("lang", "doc_id", "document_id", "chunk_index", "chunk", F.sha2("chunk", 256).alias("identity"), score.alias("score"), pos.alias("pos"))


_CHUNK = """
chunk AS (
  SELECT lang, doc_id, 'doc-' || doc_id AS document_id, source || '.txt' AS source_file, i AS chunk_index, substring(text, i * 500 + 1, 600) AS chunk
  FROM documents, LATERAL (SELECT unnest(range(0, (length(text) - 1) // 500 + 1)) AS i) WHERE length(text) > 0
)"""
_HIT = f"""{_CHUNK},
hit AS (
  SELECT *, sha256(chunk) AS identity, (length(chunk) * 7 + doc_id * 13 + chunk_index * 3) % 101 / 100.0 AS score,
    doc_id * 1000000 + chunk_index AS pos FROM chunk
)"""


@query(f"""WITH {_HIT}
SELECT lang, identity, score::DOUBLE AS score, pos AS best_pos, first_pos FROM (
  SELECT *, min(pos) OVER (PARTITION BY lang, identity) AS first_pos, row_number() OVER (PARTITION BY lang, identity ORDER BY score DESC, pos) AS n FROM hit) WHERE n = 1""")
def exact_dedup_best(spark, sf_dir):
    found = retrieval.exact_dedup(_hits(spark, sf_dir), ["lang"], "identity", "score", "pos")
    return found.select("lang", "identity", "score", F.col("pos").alias("best_pos"), "first_pos")


@query(f"""WITH {_HIT},
one AS (SELECT lang, identity, max(score) AS score, min(pos) AS first_pos FROM hit GROUP BY lang, identity)
SELECT lang, identity, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, first_pos) AS rank FROM one) WHERE rank <= 8""")
def merge_multi_query(spark, sf_dir):
    one = retrieval.exact_dedup(_hits(spark, sf_dir), ["lang"], "identity", "score", "pos")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "first_pos")))
    return ranked.where("rank <= 8").select("lang", "identity", "score", "rank")


def _streams(spark, sf_dir):
    """Three rankings of documents for each source: by length, by id, by length of the shortest first."""
    docs = tables.documents(spark, sf_dir).select("source_file", "doc_id", F.length("content").alias("n"))
    by = lambda *keys: F.row_number().over(Window.partitionBy("source_file").orderBy(*keys))
    return [docs.select("source_file", "doc_id", by(*keys).alias("pos")).where("pos <= 12") for keys in ((F.desc("n"), "doc_id"), ("doc_id",), ("n", "doc_id"))]


@query("""
WITH s AS (
  SELECT source || '.txt' AS source_file, doc_id, 0 AS stream, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS pos FROM documents
  UNION ALL SELECT source || '.txt', doc_id, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id) FROM documents
  UNION ALL SELECT source || '.txt', doc_id, 2, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) FROM documents
),
f AS (SELECT *, row_number() OVER (PARTITION BY source_file, doc_id ORDER BY pos, stream) AS n FROM s WHERE pos <= 12)
SELECT source_file, doc_id, stream, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY pos, stream) AS rank FROM f WHERE n = 1) WHERE rank <= 10""")
def round_robin_fusion(spark, sf_dir):
    return retrieval.round_robin(_streams(spark, sf_dir), 10, ["source_file"], "doc_id").select("source_file", "doc_id", "stream", "rank")


@query(f"""WITH {_CHUNK}
SELECT doc_id, chunk_index, CASE WHEN doc_id % 3 = 0 THEN document_id || '#' || chunk_index WHEN doc_id % 3 = 1 THEN sha256(document_id || '|chunk|' || sha256(chunk)) ELSE sha256(source_file || '|' || chunk) END AS identity FROM chunk""")
def stable_identity(spark, sf_dir):
    chunks, third = tables.chunks(spark, sf_dir), F.col("doc_id") % 3
    named = F.when(third == 0, F.concat("document_id", F.lit("#"), F.col("chunk_index").cast("string")))
    identity = retrieval.stable_identity(named, F.when(third == 1, F.col("document_id")), F.lit("chunk"), F.sha2("chunk", 256), F.col("source_file"), F.col("chunk"))
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), identity.alias("identity"))


_SHINGLES = """
f AS (SELECT doc_id, source, replace(lower(text), 'ß', 'ss') AS t FROM documents),
w AS (SELECT doc_id, source, regexp_replace(t, '[^a-z0-9]', '', 'g') AS c, regexp_extract_all(t, '[a-z0-9]+') AS ws FROM f),
s AS (
  SELECT DISTINCT doc_id, source, 'c:' || substring(c, i, 3) AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(length(c) - 2, 1) + 1)) AS i) WHERE length(c) > 0
  UNION SELECT DISTINCT doc_id, source, 'w:' || array_to_string(list_slice(ws, i, i + 1), ' ') FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i) WHERE len(ws) > 0
)"""


@query(f"WITH {_SHINGLES} SELECT doc_id, count(*) AS n, sha256(string_agg(g, '|' ORDER BY g)) AS digest FROM s GROUP BY doc_id")
def shingle_sets(spark, sf_dir):
    found = tables.documents(spark, sf_dir).select("doc_id", T.shingle_digest(F.col("content")).alias("s"))
    return found.select("doc_id", "s.n", "s.digest").where("n > 0")


@query(f"""WITH {_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT source || '.txt' AS source_file, a, b, round(k / (x.n + y.n - k), 6) AS similarity FROM (
  SELECT p.source, p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s AS p JOIN s AS q ON p.source = q.source AND p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL)
JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.85""")
def near_dup_pairs(spark, sf_dir):
    found = retrieval.near_dup_pairs(tables.documents(spark, sf_dir), "source_file", "doc_id", "content")
    return found.select("source_file", "a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_SHINGLES}, one AS (SELECT doc_id, any_value(source) AS source, count(*) AS n, sha256(string_agg(g, '|' ORDER BY g)) AS digest FROM s GROUP BY doc_id),
class AS (SELECT source, digest, min(doc_id) AS class_id, count(*) AS copies, any_value(n) AS n FROM one GROUP BY source, digest),
g AS (SELECT class.*, s.g FROM class JOIN s ON s.doc_id = class_id),
link AS (SELECT p.class_id AS a, q.class_id AS b FROM g AS p JOIN g AS q ON p.source = q.source AND p.g = q.g AND p.class_id <> q.class_id GROUP BY p.class_id, q.class_id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= 0.85)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copies, 1) AS copies, (SELECT count(*) FROM link WHERE a = class_id) AS links FROM documents AS d LEFT JOIN one ON one.doc_id = d.doc_id LEFT JOIN class ON class.source = one.source AND class.digest = one.digest""")
def near_dup_classes(spark, sf_dir):
    """Near copies of a source in a row a document: its class, the class's copies, and how many classes are near it."""
    members, links = retrieval.near_dup_classes(tables.documents(spark, sf_dir), "source_file", "doc_id", "content")
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


@query()
def near_dup_greedy(spark, sf_dir):
    """Chunks of each document without those that nearly repeat a better one; tests compare with a loop."""
    return retrieval.near_dup_greedy(_hits(spark, sf_dir), "document_id", "identity", "chunk", "score", "pos")


@query(f"""WITH {_HIT}, ok AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE document_id || '#0' END AS parent FROM hit),
r AS (
  SELECT c.document_id, coalesce(p.document_id || '#0', c.document_id || '#' || c.chunk_index) AS chunk_id, sha256(coalesce(p.chunk, c.chunk)) AS content_hash, c.score,
    CASE WHEN p.chunk IS NOT NULL THEN c.document_id || '#' || c.chunk_index END AS matched_chunk_id
  FROM ok AS c LEFT JOIN hit AS p ON p.document_id = c.document_id AND p.chunk_index = 0 AND c.parent = p.document_id || '#0' WHERE c.chunk_index > 0
)
SELECT document_id, chunk_id, content_hash, score::DOUBLE AS score, matched_chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY score DESC, matched_chunk_id NULLS FIRST) AS n FROM r) WHERE n = 1""")
def parent_context_expand(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("chunk_id", F.concat("document_id", F.lit("#"), F.col("chunk_index").cast("string"))).withColumnRenamed("chunk", "content").withColumn("granularity", F.lit("paragraph"))
    children = hits.where("chunk_index > 0").withColumn("parent_chunk_id", F.when(F.col("doc_id") % 7 != 0, F.concat("document_id", F.lit("#0"))))
    found = retrieval.parent_context(children, hits.where("chunk_index = 0"))
    return found.select("document_id", "chunk_id", F.sha2("content", 256).alias("content_hash"), "score", "matched_chunk_id")


@query("""SELECT doc_id, coalesce(text, '') AS content, source || '.txt' AS source_file, '' AS source_path, coalesce(nullif(lang, 'en'), '') AS section_title, '' AS category, length(text) / 100.0::DOUBLE AS score,
  CAST(NULL AS DOUBLE) AS rerank_score, 'keyword' AS retrieval_channel, 'doc-' || doc_id AS document_id, CAST(NULL AS VARCHAR) AS chunk_id, 'document' AS granularity, CAST(NULL AS VARCHAR) AS matched_chunk_id, CAST(NULL AS VARCHAR) AS matched_granularity FROM documents""")
def evidence_projection(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).withColumns({"section_title": F.nullif("lang", F.lit("en")), "score": F.length("content") / 100.0, "retrieval_channel": F.lit("keyword"), "granularity": F.lit("document")})
    return retrieval.evidence(docs, "doc_id")


_TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"


@query(f"""WITH {_HIT}
SELECT lang, pos, cost, CAST(used AS BIGINT) AS used FROM (SELECT lang, pos, cost, sum(cost) OVER (PARTITION BY lang ORDER BY pos) AS used FROM (SELECT lang, pos, {_TOKENS.format('chunk')} + 16 AS cost FROM hit)) WHERE used <= 6000""")
def budget_chunk_prefix(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return retrieval.fit_chunks(hits, ["lang"], "pos", 6000, "chunk").select("lang", "pos", "cost", "used")


@query(f"""WITH {_HIT},
first AS (SELECT document_id, chunk, {_TOKENS.format('chunk')} + 16 AS cost FROM hit WHERE chunk_index = 0),
cut AS (SELECT document_id, cost > 100 AS truncated, CASE WHEN cost > 100 THEN regexp_replace(substring(chunk, 1, 83), '\\s+$', '') || '…' ELSE chunk END AS content FROM first)
SELECT document_id, truncated, sha256(content) AS content_hash, {_TOKENS.format('content')} + 16 AS used FROM cut""")
def budget_first_truncated(spark, sf_dir):
    """A small budget for each document: the first chunk is cut to fit."""
    hits = _hits(spark, sf_dir).where("chunk_index = 0").drop("doc_id")
    fitted = retrieval.fit_chunks(hits, ["document_id"], "pos", 100, "chunk")
    return fitted.select("document_id", "truncated", F.sha2("chunk", 256).alias("content_hash"), "used")


@query(f"""WITH r AS (
  SELECT conv_id, turn, role || ' -> says -> ' || conv_id AS path, text AS description, {_TOKENS.format("(role || ' -> says -> ' || conv_id)")} AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT *, p + {_TOKENS.format('text')} + 12 AS cost FROM (SELECT *, description AS text FROM r) WHERE n = 1),
c AS (SELECT *, cost > 40 AND length(description) > 0 AS cut, greatest(1, 40 - p - 12) AS room FROM f)
SELECT conv_id, cost > 40 AS truncated, sha256(CASE WHEN cut AND {_TOKENS.format('description')} > room THEN regexp_replace(substring(description, 1, CAST(greatest(1, room - 1) AS INT)), '\\s+$', '') || '…' ELSE description END) AS description_hash FROM c""")
def budget_first_relation(spark, sf_dir):
    """The first relation of each conversation within 40 tokens; its description is cut where it is longer."""
    turns = tables.table(spark, sf_dir, "conversations")
    first = turns.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("_n = 1")
    path = F.concat("role", F.lit(" -> says -> "), F.col("conv_id").cast("string"))
    paths = first.select("conv_id", "turn", path.alias("path"), F.col("text").alias("description"), F.lit("").alias("evidence"))
    return retrieval.fit_relations(paths, ["conv_id"], "turn", 40).select("conv_id", "truncated", F.sha2("description", 256).alias("description_hash"))


@query(f"""
SELECT role, pos, cost, CAST(used AS BIGINT) AS used FROM (
  SELECT role, pos, cost, sum(cost) OVER (PARTITION BY role ORDER BY pos) AS used FROM (
    SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS pos, {_TOKENS.format("(role || ' -> says -> ' || conv_id)")} + {_TOKENS.format('text')} + {_TOKENS.format('role')} + 12 AS cost FROM conversations)) WHERE used <= 1500""")
def budget_relation_prefix(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations")
    # No more than 125 turns of a role can be within 1500 tokens, at 12 each or more.
    turns = turns.withColumn("pos", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))).where("pos <= 125")
    path = F.concat("role", F.lit(" -> says -> "), F.col("conv_id").cast("string"))
    return retrieval.budget_prefix(turns, ["role"], "pos", retrieval.relation_cost(path, F.col("text"), F.col("role")), 1500, 12).select("role", "pos", "cost", "used")


@query(f"SELECT doc_id, CAST({_TOKENS.format('text')} AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("content")).alias("tokens"))


def _count(terms):
    return " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in terms)


@query(f"SELECT item_id, CAST(least(10, 2 + least(2, (length(text) >= 36)::INT + ({_count(LATIN.clause_signals)} >= 2)::INT + ({_count(LATIN.requirement_signals)} >= 3)::INT)) AS BIGINT) AS top_k FROM benchmark")
def dynamic_top_k(spark, sf_dir):
    return tables.table(spark, sf_dir, "benchmark").select("item_id", retrieval.dynamic_top_k(F.col("text"), 2, LATIN.clause_signals, LATIN.requirement_signals).alias("top_k"))


@query(f"""WITH {_VEC}, ok AS (SELECT * FROM vec WHERE doc_id % 3 <> 0 OR doc_id % 5 IN (1, 2)), {_SCORED.format(rows='ok')},
v AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, v DESC, doc_id) AS pos, 0 AS stream FROM scored QUALIFY pos <= 10),
k AS (SELECT doc_id, row_number() OVER (ORDER BY least(1.0, 0.35 + 0.08 * hits) DESC, doc_id) AS pos, 1 AS stream FROM (SELECT doc_id, {_HITS} AS hits FROM documents) WHERE hits > 0 AND (doc_id % 3 <> 0 OR doc_id % 5 IN (1, 2)) QUALIFY pos <= 50),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, stream) AS n FROM (SELECT * FROM v UNION ALL SELECT * FROM k)),
r AS (SELECT doc_id, stream, row_number() OVER (ORDER BY pos, stream) AS rank FROM f WHERE n = 1 QUALIFY rank <= 50),
b AS (SELECT r.*, sum({_TOKENS.format('text')} + 16) OVER (ORDER BY rank) AS used, CASE WHEN rank = 1 THEN regexp_replace(substring(text, 1, 5983), '\\s+$', '') || '…' END AS cut FROM r JOIN documents USING (doc_id))
SELECT doc_id, stream, rank, CAST(CASE WHEN used > 6000 THEN {_TOKENS.format('cut')} + 16 ELSE used END AS BIGINT) AS used FROM b WHERE used <= 6000 OR rank = 1""")
def hybrid_evidence(spark, sf_dir):
    """The flagship: access rules, vector and keyword streams, interleaving, context budget (a first hit that is too long
    is cut)."""
    docs = tables.documents(spark, sf_dir)
    allowed = governance.allowed(tables.access(docs), "someone", ["r1", "r2"], []).select("doc_id")
    near = retrieval.vector_search(tables.vectors(spark, sf_dir).join(allowed, "doc_id", "left_semi"), _query_vector(spark, sf_dir), "c3", ENTITIES, FILES, candidate_k=50, min_score=0.0)
    # After their limits the streams hold at most 50 rows: one task ranks them.
    near = near.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("vector_score"), "doc_id"))).where("pos <= 10")
    words = retrieval.term_frequency_search(docs.join(allowed, "doc_id", "left_semi"), TERMS, 50, "doc_id")
    words = words.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    ranked = retrieval.round_robin([near.select("doc_id", "content", "pos"), words.select("doc_id", "content", "pos")], 50, [], "doc_id")
    return retrieval.fit_chunks(ranked, [], "rank", 6000).select("doc_id", "stream", "rank", "used")
