"""Queries of graph records, of rules for schemas and questions, and of the contexts of answers."""

from __future__ import annotations

from fathom.operators import records, retrieval
from fathom.session import cut
from fathom.sources import tables
from pyspark.sql import functions as F

from . import batch, evidence
from .registry import query


@query("""WITH doc AS (SELECT s_nationkey, 'doc-' || s_suppkey AS d, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
node AS (SELECT 'nation-' || n_nationkey AS id, n_name AS label, r_name AS category, d, coalesce(n, 0) AS n FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN doc ON s_nationkey = n_nationkey)
SELECT 'entity::' || id || coalesce('::doc::' || d, '') AS record_id, '实体：' || label || chr(10) || '类型：nation' || chr(10) || '分类：' || category || chr(10) || '来源文件：' || CASE WHEN n <= 1 THEN 'nations.txt、suppliers.txt' ELSE '' END AS text, coalesce(d, '') AS document_id FROM node""")
def entity_records(spark, sf_dir):
    """Nations as nodes, a record for each supplier's document; those of several don't show their files."""
    suppliers = tables.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set(F.concat(F.lit("doc-"), F.col("s_suppkey").cast("string"))).alias("document_ids"))
    regions = tables.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("category"))
    nodes = tables.table(spark, sf_dir, "nation").join(regions, "n_regionkey").join(suppliers, "n_nationkey", "left")
    named = nodes.select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), "category", F.array(F.lit("nations.txt"), F.lit("suppliers.txt")).alias("source_files"), "document_ids")
    return records.entity_records(named).select("record_id", "text", "document_id")


@query(f"""WITH {evidence._EDGES}
SELECT 'relationship::' || source || '->' || label || '->' || target AS record_id, '关系：' || source || ' ' || label || ' ' || target || chr(10) || '描述：' || description || chr(10) || '证据：' || evidence || chr(10) || '来源文件：' || source_file AS text, coalesce(confidence, 0.8)::DOUBLE AS confidence FROM edge""")
def relationship_records(spark, sf_dir):
    return records.relationship_records(evidence._edges(spark, sf_dir)).select("record_id", "text", "confidence")


@query("""WITH item AS (SELECT source AS category, source || '.txt' AS file, row_number() OVER (ORDER BY source) % 2 = 0 AS listed FROM (SELECT DISTINCT source FROM documents))
SELECT category, 'listed-' || category AS document_id, file AS source_file FROM item WHERE listed
UNION ALL SELECT category, 'doc-' || doc_id, source || '.txt' FROM item JOIN documents ON source || '.txt' = file WHERE NOT listed""")
def category_documents(spark, sf_dir):
    """Sources as categories, every other one with its documents listed."""
    docs = tables.documents(spark, sf_dir)
    names = docs.select("source_file").distinct().orderBy("source_file")
    order = names.select("source_file", F.regexp_replace("source_file", r"\.txt$", "").alias("category"))
    ranked = order.groupBy().agg(F.array_sort(F.collect_list("category")).alias("all")).select(F.posexplode("all").alias("at", "category"))  # one row a source
    file = F.concat("category", F.lit(".txt"))
    listed = F.when(F.col("at") % 2 == 1, F.array(F.struct(F.concat(F.lit("listed-"), "category").alias("document_id"), file.alias("source_file"))))
    categories = ranked.select("category", F.array(file).alias("source_files"), listed.alias("document_sources"))
    return records.category_documents(categories, docs)


_FIELD = """field AS (SELECT p_brand AS schema, CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'edge' END AS kind, p_partkey AS position,
  ['id', 'label', 'type', 'category', 'source_files', 'source', 'target', 'evidence', 'secret', ' id ', 'relation', 'confidence'][p_size % 12 + 1] AS key, p_name || ' ' || p_type AS label, ['string', 'number', 'list', 'odd'][p_size % 4 + 1] AS type FROM part)"""
_NODES, _EDGES = (", ".join(f"'{x}'" for x in fields) for fields in (records.NODE_FIELDS, records.EDGE_FIELDS))


@query(f"""WITH {_FIELD},
told AS (SELECT *, CASE WHEN kind = 'node' AND trim(key) IN ({_NODES}) OR kind = 'edge' AND trim(key) IN ({_EDGES}) THEN '' ELSE 'unknown' END AS wrong FROM field),
once AS (SELECT *, row_number() OVER (PARTITION BY schema, kind, trim(key), wrong ORDER BY position) AS n FROM told)
SELECT schema, position, trim(key) AS key, trim(substring(trim(label), 1, 32)) AS label, CASE WHEN type = 'odd' THEN 'string' ELSE type END AS type, CASE WHEN wrong = '' AND n > 1 THEN 'repeated' ELSE wrong END AS reason FROM once""")
def schema_fields(spark, sf_dir):
    """Parts as fields of a schema a brand, with what was wrong with each."""
    part, size = tables.table(spark, sf_dir, "part"), F.col("p_size")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (size % len(values) + 1).cast("int"))
    keys = ("id", "label", "type", "category", "source_files", "source", "target", "evidence", "secret", " id ", "relation", "confidence")
    fields = part.select(F.col("p_brand").alias("schema"), F.when(F.col("p_partkey") % 2 == 0, "node").otherwise("edge").alias("kind"), F.col("p_partkey").alias("position"), pick(keys).alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("label"), pick(("string", "number", "list", "odd")).alias("type"))
    found = records.schema_fields(fields, ["schema"])
    return found.select("schema", "position", "key", F.trim("label").alias("label"), "type", "reason")


@query("""WITH raw AS (SELECT conv_id % 20 AS set_id, conv_id * 100 + turn AS position, trim(substring(text, 1, 4)) AS question, role FROM conversations),
told AS (SELECT *, CASE WHEN question = '' THEN 'blank' ELSE '' END AS wrong FROM raw),
once AS (SELECT *, CASE WHEN wrong = '' AND row_number() OVER (PARTITION BY set_id, question, wrong ORDER BY position) > 1 THEN 'repeated' ELSE wrong END AS w FROM told),
held AS (SELECT *, count(*) FILTER (WHERE w = '') OVER (PARTITION BY set_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS n FROM once)
SELECT set_id, position, question, CASE role WHEN 'user' THEN 'user questions' WHEN 'system' THEN 'system' ELSE 'user questions' END AS category, CASE WHEN w = '' AND n > 14 THEN 'beyond' ELSE w END AS reason FROM held""")
def generated_questions(spark, sf_dir):
    """Beginnings of turns as questions that were made up, with the closest category and what was wrong with each."""
    turns = tables.table(spark, sf_dir, "conversations")
    raw = turns.select((F.col("conv_id") % 20).alias("set_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("position"), F.lit(None).cast("string").alias("id"), F.substring("text", 1, 4).alias("question"), F.col("role").alias("category"))
    found = records.generated_questions(raw, ["set_id"], ["user questions", "other"], ("system",))
    return found.select("set_id", "position", "question", "category", "reason")


@query()
def answer_contexts(spark, sf_dir):
    """What every first turn's answer is made from: the tool's chunks and the paths of a nation, within a budget."""
    hits, questions, _ = batch._tool(spark, sf_dir, "parent_context_enabled")
    hits = cut(hits.drop("profile")).withColumns({"section_title": F.substring("content", 1, 20), "category": F.lit("")})
    edges = evidence._edges(spark, sf_dir).withColumn("score", F.coalesce("confidence", F.lit(0.8))).where("label = 'part of'")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    paths = evidence.evidence.as_paths(edges, "entity_vector").join(edges.select(F.concat_ws(" -> ", "source", "label", "target").alias("path"), number.alias("n")), "path")
    asked = questions.select("question_id", "question", (F.col("question_id") % 25).alias("n"))
    told = asked.join(paths, "n").withColumn("pos", F.lit(1)).drop("question", "n")
    chunks, told = retrieval.in_context(asked.drop("n"), hits, told, 300, ["question_id"])
    found = records.answer_context(chunks, told, asked, ["question_id"])
    return found.select("question_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_hash"))
