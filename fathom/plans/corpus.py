"""Queries of the corpus and its graph: categories, roll-ups, change detection, nodes, edges and paths."""

from __future__ import annotations

from fathom.operators import chunking, corpus, governance, terms
from fathom.params import LATIN
from fathom.session import cut
from fathom.sources import tables
from pyspark.sql import functions as F

from .registry import query

ENTITIES = ["supplier-1", "supplier-2", "customer-7", "nation-3", "region-0", "region-1", "region-2"]
TERMS = ["supplier-1", "nation-3", "located", "region-2"]
FILES, SAID = ["src0.txt", "src3.txt"], ["token", "license"]


def _sum(text: str, words) -> str:
    return " + ".join(f"contains({text}, '{w}')::INT" for w in words) or "0"


_FILE_CATEGORY = r"coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(source || '.txt', '\.[A-Za-z0-9]+$', ''), '(?i)(?:document|file|guide|manual)', '', 'g'), '^[ _\-0-9]+|[ _\-0-9]+$', '', 'g'), 1, 16), ''), 'other')"
_N = {name: f"({_sum('seen', words)})" for name, words in LATIN.categories.items()}
_BEST = f"greatest({', '.join(_N.values())})"
_LADDER = f"CASE WHEN {_BEST} = 0 THEN {_FILE_CATEGORY} " + " ".join(f"WHEN {n} = {_BEST} THEN '{name}'" for name, n in _N.items()) + " END"
_DOC = f"doc AS (SELECT doc_id, 'doc-' || doc_id AS document_id, source || '.txt' AS source_file, text, {_LADDER} AS category FROM (SELECT *, source || '.txt' || chr(10) || substring(text, 1, 1200) AS seen FROM documents))"
_TOPICS = ", ".join("CASE WHEN {} THEN '{}' END".format(" OR ".join(f"contains(lower(text), '{t}')" for t in terms), name) for name, terms in LATIN.entities.items())
_MEMBER = f"""{_DOC}, topics AS (SELECT *, list_filter([{_TOPICS}], lambda x: x IS NOT NULL) AS ts FROM doc),
member AS (SELECT document_id, source_file, category, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS topic FROM topics)"""


def _docs(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return docs.withColumn("category", corpus.infer_category(F.col("source_file"), F.col("content"), LATIN.categories))


def _members(spark, sf_dir):
    return corpus.memberships(_docs(spark, sf_dir), LATIN.entities)


@query(f"WITH {_DOC} SELECT doc_id, category FROM doc")
def category_inference(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "category")


@query(f"""WITH {_DOC}
SELECT category, count(*) AS document_count, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - 1) // 500 + 1 END) AS BIGINT) AS chunk_count, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files FROM doc GROUP BY category""")
def category_rollup(spark, sf_dir):
    found = corpus.rollup_counted(_docs(spark, sf_dir), chunking.window_count(F.col("content"), 600, 100))
    return found.withColumn("source_files", F.array_join("source_files", ","))


@query(f"""WITH {_DOC}
SELECT category, document_id, source_file, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - 1) // 500 + 1 END AS BIGINT) AS chunk_count, array_to_string(list_sort(list_filter([{', '.join(repr(w) for words in LATIN.categories.values() for w in words)}], lambda w: contains(source_file || chr(10) || substring(text, 1, 1200), w))), ',') AS keyword_hits FROM doc""")
def category_documents_rollup(spark, sf_dir):
    """What the roll-up says of each document of a category: its chunks and the keywords that it has."""
    docs = _docs(spark, sf_dir)
    words = [w for words in LATIN.categories.values() for w in words]
    seen = F.concat("source_file", F.lit("\n"), F.substring("content", 1, 1200))
    named = docs.withColumn("keywords", F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(seen, w)))
    chunks = tables.chunks(spark, sf_dir).select("doc_id").join(docs.select("doc_id", "document_id", "category"), "doc_id")
    found = corpus.rollup_by_document(named, chunks)
    return found.withColumn("keyword_hits", F.array_join("keyword_hits", ","))


@query(f"""WITH {_DOC}, chunk AS (SELECT doc_id, unnest(range(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - 1) // 500 + 1 END)) AS i FROM documents)
SELECT category, count(DISTINCT doc_id) AS document_count, count(i) AS chunk_count, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files FROM doc LEFT JOIN chunk USING (doc_id) GROUP BY category""")
def category_rollup_of_chunks(spark, sf_dir):
    """The roll-up of documents and of chunks that are there as rows."""
    docs = _docs(spark, sf_dir)
    chunks = tables.chunks(spark, sf_dir).select("doc_id").join(docs.select("doc_id", "category"), "doc_id")
    return corpus.rollup(docs, chunks).withColumn("source_files", F.array_join("source_files", ","))


@query(f"""WITH {_DOC} SELECT doc_id, {" || '|' || ".join(f"array_to_string(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(source_file || chr(10) || substring(text, 1, 1200), w)), ',')" for words in LATIN.categories.values())} AS hits FROM doc""")
def keyword_hits(spark, sf_dir):
    seen = F.concat("source_file", F.lit("\n"), F.substring("content", 1, 1200))
    hits = [F.array_join(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(seen, w)), ",") for words in LATIN.categories.values()]
    return tables.documents(spark, sf_dir).select("doc_id", F.concat_ws("|", *hits).alias("hits"))


@query("SELECT sha256(text) AS content_hash, count(*) - 1 AS duplicates, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    hashed = tables.documents(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("content_hash"))
    found = hashed.groupBy("content_hash").agg((F.count("*") - 1).alias("duplicates"), F.min("doc_id").alias("first_doc"))
    return found.where("duplicates > 0")


_STATE = """
now AS (SELECT doc_id, sha256(text) AS h FROM documents),
before AS (
  SELECT doc_id, CASE WHEN length(text) % 11 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE length(text) % 7 <> 0
  UNION ALL SELECT -1 - doc_id, sha256(text) FROM documents WHERE length(text) % 7 = 0
)"""


def _states(spark, sf_dir):
    """The documents now, and as an earlier generation had them: some new since, some changed, some gone."""
    docs, n = tables.documents(spark, sf_dir), F.length("content")
    now = docs.select("doc_id", F.sha2("content", 256).alias("h"))
    kept = docs.where(n % 7 != 0).select("doc_id", F.sha2(F.when(n % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("h"))
    return now, kept.unionByName(docs.where(n % 7 == 0).select((-1 - F.col("doc_id")).alias("doc_id"), F.sha2("content", 256).alias("h")))


@query(f"""WITH {_STATE}
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN n.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM now AS n FULL JOIN before AS b USING (doc_id)""")
def document_status_diff(spark, sf_dir):
    return governance.status_diff(*_states(spark, sf_dir), "doc_id", "h")


@query(f"WITH {_STATE} SELECT doc_id FROM before WHERE doc_id NOT IN (SELECT doc_id FROM now)")
def removed_documents(spark, sf_dir):
    now, before = _states(spark, sf_dir)
    return before.join(now, "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey, o_orderdate AS deleted_at FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1998-06-30' - INTERVAL 30 DAY")
def tombstone_retention(spark, sf_dir):
    gone = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return gone.where("o_orderdate >= timestamp'1998-06-30' - interval 30 days").select("o_orderkey", F.col("o_orderdate").alias("deleted_at"))


_REUSE = """
k AS (SELECT DISTINCT sha256(text) AS chunk_hash, lang AS granularity FROM documents),
a AS (SELECT sha256(text) AS chunk_hash, lang AS granularity, 'active-' || min(doc_id) AS v FROM documents WHERE length(text) % 2 = 0 GROUP BY ALL),
p AS (SELECT sha256(text) AS chunk_hash, lang AS granularity, 'previous-' || min(doc_id) AS v FROM documents WHERE length(text) % 3 = 0 GROUP BY ALL),
r AS (SELECT chunk_hash, granularity, coalesce(a.v, p.v) AS vector FROM k LEFT JOIN a USING (chunk_hash, granularity) LEFT JOIN p USING (chunk_hash, granularity))"""


def _reuse(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select(F.sha2("content", 256).alias("chunk_hash"), F.col("lang").alias("granularity"), "doc_id", F.length("content").alias("n"))
    source = lambda name, by: docs.where(F.col("n") % by == 0).groupBy("chunk_hash", "granularity").agg(F.concat(F.lit(f"{name}-"), F.min("doc_id").cast("string")).alias("vector"))
    return governance.reuse_join(docs, [source("active", 2), source("previous", 3)], ["chunk_hash", "granularity"], "vector")


@query(f"WITH {_REUSE} SELECT * FROM r")
def embedding_reuse_join(spark, sf_dir):
    return _reuse(spark, sf_dir)


@query(f"WITH {_REUSE} SELECT count(*) AS wanted, count(vector) AS reused, count(*) - count(vector) AS embedded FROM r")
def embedding_reuse_stats(spark, sf_dir):
    return _reuse(spark, sf_dir).agg(F.count("*").alias("wanted"), F.count("vector").alias("reused"), F.count_if(F.col("vector").isNull()).alias("embedded"))


@query(f"""WITH {_MEMBER}, every AS (
  SELECT 'category:' || category AS id, 'category' AS kind, category AS label, document_id, source_file FROM member
  UNION ALL SELECT 'file:' || source_file, 'file', source_file, document_id, source_file FROM member
  UNION ALL SELECT 'topic:' || topic, 'topic', topic, document_id, source_file FROM member WHERE topic IS NOT NULL)
SELECT id, min(kind) AS kind, min(label) AS label, count(DISTINCT document_id) AS documents, count(DISTINCT source_file) AS files FROM every GROUP BY id""")
def graph_nodes(spark, sf_dir):
    return corpus.graph_nodes(_members(spark, sf_dir))


_EDGE = f"""{_MEMBER}, every AS (
  SELECT 'category:' || category AS source, 'contains' AS label, 'file:' || source_file AS target, source_file, document_id FROM member
  UNION ALL SELECT 'file:' || source_file, 'mentions', 'topic:' || topic, source_file, document_id FROM member WHERE topic IS NOT NULL
  UNION ALL SELECT 'category:' || category, 'relates', 'topic:' || topic, source_file, document_id FROM member WHERE topic IS NOT NULL),
edge AS (SELECT source, label, target, source_file, count(DISTINCT document_id) AS evidence FROM every GROUP BY ALL)"""


@query(f"WITH {_EDGE} SELECT * FROM edge")
def graph_edges(spark, sf_dir):
    return corpus.graph_edges(_members(spark, sf_dir))


@query(f"WITH {_EDGE}, ends AS (SELECT source AS n FROM edge UNION SELECT target FROM edge) SELECT (SELECT count(*) FROM ends) AS nodes, count(*) AS edges, count(DISTINCT source_file) AS source_files, CAST(sum(evidence) AS BIGINT) AS evidence FROM edge")
def graph_stats(spark, sf_dir):
    edges = cut(corpus.graph_edges(_members(spark, sf_dir)))  # for both of what follows
    ends = edges.select(F.explode(F.array("source", "target")).alias("n")).agg(F.countDistinct("n").alias("nodes"))
    return ends.join(edges.agg(F.count("*").alias("edges"), F.countDistinct("source_file").alias("source_files"), F.sum("evidence").alias("evidence")))


@query(f"""WITH {_MEMBER}, ok AS (SELECT document_id FROM doc WHERE doc_id % 3 <> 0 OR doc_id % 5 IN (1, 2)), every AS (
  SELECT 'category:' || category AS id, document_id FROM member UNION ALL SELECT 'file:' || source_file, document_id FROM member UNION ALL SELECT 'topic:' || topic, document_id FROM member WHERE topic IS NOT NULL)
SELECT id, count(DISTINCT document_id) AS documents FROM every JOIN ok USING (document_id) GROUP BY id""")
def graph_acl_filter(spark, sf_dir):
    allowed = governance.allowed(tables.access(tables.documents(spark, sf_dir)), "someone", ["r1", "r2"], []).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    return corpus.graph_nodes(_members(spark, sf_dir).join(allowed, "document_id", "left_semi")).select("id", "documents")


@query(f"WITH {_MEMBER} SELECT DISTINCT 'topic:' || topic AS node, document_id FROM member WHERE topic IS NOT NULL UNION ALL SELECT 'topic:none', ''")
def entity_vector_rows(spark, sf_dir):
    """A row a node and document, and one with an empty id for a node without documents."""
    topics = _members(spark, sf_dir).where("topic is not null").select(F.concat(F.lit("topic:"), "topic").alias("node"), "document_id").distinct()
    return topics.unionByName(spark.createDataFrame([("topic:none", "")], "node string, document_id string"))


_LINK = """link AS (
  SELECT 'nation-' || n_nationkey AS source, 'part of' AS label, 'region-' || n_regionkey AS target, 'nations.txt' AS source_file FROM nation
  UNION ALL SELECT 'supplier-' || s_suppkey, 'located in', 'nation-' || s_nationkey, 'suppliers.txt' FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey, 'located in', 'nation-' || c_nationkey, 'customers.txt' FROM customer
)"""
_S = ", ".join(f"'{e}'" for e in ENTITIES)


@query(f"WITH {_LINK} SELECT DISTINCT source || ' -> ' || label || ' -> ' || target AS path, source_file FROM link WHERE source IN ({_S}) OR target IN ({_S})")
def one_hop_paths(spark, sf_dir):
    return corpus.one_hop(tables.edges(spark, sf_dir), ENTITIES)


_TWO = f"two AS (SELECT DISTINCT a.source || ' -> ' || a.label || ' -> ' || a.target || ' -> ' || b.label || ' -> ' || b.target AS path, a.source AS x, a.label AS l, a.target AS y, b.label AS m, b.target AS z FROM link AS a JOIN link AS b ON a.target = b.source WHERE a.source IN ({_S}) AND b.target IN ({_S}))"


@query(f"WITH {_LINK}, {_TWO} SELECT path FROM two")
def two_hop_paths(spark, sf_dir):
    return corpus.two_hop(tables.edges(spark, sf_dir), ENTITIES)


@query(f"WITH {_LINK}, {_TWO} SELECT x AS source, l AS label, y AS target FROM two UNION SELECT y, m, z FROM two")
def subgraph_explode(spark, sf_dir):
    return corpus.path_edges(corpus.two_hop(tables.edges(spark, sf_dir), ENTITIES))


@query(f"WITH {_LINK}, {_TWO} SELECT x AS entity FROM two UNION SELECT y FROM two UNION SELECT z FROM two")
def path_entities(spark, sf_dir):
    return corpus.path_entities(corpus.two_hop(tables.edges(spark, sf_dir), ENTITIES))


_CONFIDENCE = "(length(source) % 5 / 5.0::DOUBLE)"


@query(f"""WITH {_LINK}, s AS (SELECT *, (source IN ({_S}))::INT + (target IN ({_S}))::INT AS ends, {_sum("(source || ' ' || label || ' ' || target)", TERMS)} AS found FROM link)
SELECT source, target, round(CASE WHEN ends + found = 0 THEN 0 ELSE least(1.0, 0.5 * {_CONFIDENCE} + 0.12 * ends + least(0.32, 0.08 * found)) END, 6)::DOUBLE AS score FROM s""")
def dynamic_edge_score(spark, sf_dir):
    return tables.edges(spark, sf_dir).select("source", "target", F.round(corpus.edge_score(TERMS, ENTITIES, F.length("source") % 5 / 5.0), 6).alias("score"))


@query(f"""WITH {_LINK}, hit AS (SELECT 'nation-' || n_nationkey AS node, n_nationkey % 10 / 10.0::DOUBLE AS score FROM nation),
e AS (SELECT source, target, score, {_CONFIDENCE} AS c FROM link JOIN hit ON node = source UNION ALL SELECT source, target, score, {_CONFIDENCE} FROM link JOIN hit ON node = target)
SELECT source, target, round(least(1.0, greatest(max(score), max(c))), 6)::DOUBLE AS score FROM e GROUP BY source, target""")
def entity_hit_edges(spark, sf_dir):
    hits = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("node"), (F.col("n_nationkey") % 10 / 10.0).alias("score"))
    edges = tables.edges(spark, sf_dir).withColumn("confidence", F.length("source") % 5 / 5.0)
    return corpus.hit_edges(hits, edges, ["source", "target"], "confidence").select("source", "target", F.round("score", 6).alias("score"))


@query("SELECT doc_id, round(least(1.0, length(text) % 50 / 100.0 + 0.65 * (source IN ('src0', 'src3'))::INT + 0.25 * (contains(text, 'token') OR contains(text, 'license'))::INT), 6)::DOUBLE AS score FROM documents")
def relation_boost(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return docs.select("doc_id", F.round(corpus.relation_boost(F.length("content") % 50 / 100.0, F.col("source_file"), F.col("content"), FILES, SAID), 6).alias("score"))


@query(f"SELECT doc_id, array_to_string(list_filter([{_TOPICS}], lambda x: x IS NOT NULL), ',') AS entities FROM documents")
def entity_alias_match(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", F.array_join(corpus.entity_matches(F.col("content"), LATIN.entities), ",").alias("entities"))


_NOTE = """note AS (SELECT l_orderkey, string_agg(said, ', ' ORDER BY l_linenumber, said) AS body FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN p_name || ' by ' || p_brand ELSE p_name END AS said FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey),
base AS (SELECT DISTINCT p_brand AS topic, p_name AS keyword FROM part),
found AS (SELECT l_orderkey, t FROM note, (SELECT keyword AS t FROM base UNION SELECT topic FROM base) WHERE contains(body, t))"""


def _notes(spark, sf_dir):
    """Orders as notes that name their parts, and the brand of the first."""
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    parts = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    said = F.when(F.col("l_linenumber") == 1, F.concat_ws(" by ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    each = lines.join(parts, "p_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("said")))).alias("s"))
    return each.select("l_orderkey", F.array_join(F.col("s.said"), ", ").alias("body"))


def _parts(spark, sf_dir):
    """A file a brand, with the names of its parts as keywords."""
    part = tables.table(spark, sf_dir, "part")
    return part.groupBy(F.concat("p_brand", F.lit(".txt")).alias("source_file")).agg(F.collect_set("p_name").alias("keywords"))


@query(f"""WITH {_NOTE}
SELECT l_orderkey, coalesce((SELECT string_agg(t || '.txt', ',' ORDER BY t || '.txt') FROM found AS f WHERE f.l_orderkey = note.l_orderkey AND t LIKE 'Brand%'), '') AS files,
  coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM found AS f WHERE f.l_orderkey = note.l_orderkey), '') AS terms FROM note""")
def knowledge_base_terms(spark, sf_dir):
    """What of the knowledge base each note names: every name of a part is a term, and every brand a file."""
    found = terms.knowledge_terms(_notes(spark, sf_dir), ["l_orderkey"], "body", _parts(spark, sf_dir))
    return found.select("l_orderkey", F.array_join("files", ",").alias("files"), F.array_join("terms", ",").alias("terms"))


@query(f"WITH {_NOTE} SELECT l_orderkey, t AS term, CAST((length(body) - length(replace(body, t, ''))) // length(t) AS BIGINT) AS n FROM found JOIN note USING (l_orderkey)")
def term_hits(spark, sf_dir):
    """Every name of a part and of a brand in every note, with its occurrences."""
    part = tables.table(spark, sf_dir, "part")
    said = part.select(F.col("p_name").alias("term")).unionByName(part.select(F.col("p_brand").alias("term")))
    return terms.term_hits(_notes(spark, sf_dir), ["l_orderkey"], "body", said)
