"""Queries of document names, topics, change capture, reuse and access to results."""

from __future__ import annotations

from fathom.functions import text as T
from fathom.operators import governance
from fathom.sources import tables
from pyspark.sql import functions as F

from .registry import query


@query("""SELECT doc_id, 'doc-' || substring(sha1(lower('KB/' || source || '/' || doc_id || '.TXT')), 1, 16) AS path_id, 'doc-' || substring(sha256('kb1:' || lower(source || '/' || doc_id || '.TXT')), 1, 20) AS automatic_id FROM documents""")
def document_ids(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    own = T.path_document_id(F.concat(F.lit("KB\\"), F.replace(path, F.lit("/"), F.lit("\\"))))
    return docs.select("doc_id", own.alias("path_id"), T.automatic_document_id(F.lit("kb1"), path).alias("automatic_id"))


_QUOTES = r"""["“「『《]([^"“”「」『』《》]{2,30})["”」』》]"""


@query(f"""WITH d AS (SELECT doc_id, 'v1.2 ' || source || '_notes' AS stem, regexp_extract_all(substring(text, 1, 1200), '{_QUOTES}', 1) AS said, source AS title FROM documents),
t AS (SELECT doc_id, said || [title] AS every FROM d)
SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(every, range(1, len(every) + 1)), lambda x: list_position(every, x[1]) = x[2]), lambda x: x[1]), '|') AS topics FROM t""")
def source_topics(spark, sf_dir):
    """Terms quoted at the head of texts, then the cleaned title."""
    docs = tables.table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("v1.2 "), F.col("source"), F.lit("_notes"))
    return docs.select("doc_id", F.array_join(T.source_topics(stem, F.col("text")), "|").alias("topics"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN [trim(y) FOR y IN string_split(replace(substring(text, 1, 80), '.', ','), ',')] IF x <> ''])), '|') AS names FROM documents WHERE length(text) > 0")
def header_lists(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").where("length(text) > 0")
    return docs.select("doc_id", F.array_join(T.header_list(F.replace(F.substring("text", 1, 80), F.lit("."), F.lit(","))), "|").alias("names"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substring('知识库手册第' || repeat('甲', CAST(doc_id % 20 AS INT)), 1, 16) ELSE '' END AS name FROM documents")
def knowledge_base_names(spark, sf_dir):
    named = "CASE doc_id % 3 WHEN 0 THEN '知识库-手册 ' || source || '第' || repeat('甲', CAST(doc_id % 20 AS INT)) WHEN 1 THEN '短名' || doc_id ELSE 'name' END"
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.ideographic_name(F.expr(named)).alias("name"))


@query("SELECT doc_id, doc_id % 2 = 0 OR doc_id % 3 = 0 AS inside FROM documents")
def role_subset(spark, sf_dir):
    asked = F.expr("CASE WHEN doc_id % 2 = 0 THEN array('a') WHEN doc_id % 3 = 0 THEN array('b', 'a', 'b') ELSE array('a', 'z') END")
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.subset_of(asked, F.array(F.lit("a"), F.lit("b"))).alias("inside"))


@query("""WITH one AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 3 <> 0),
two AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256('new' || text) ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 3 <> 1),
three AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256('new' || text) ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 7 <> 0 OR doc_id % 33 = 1),
second AS (SELECT doc_id, coalesce(two.digest, one.digest) AS digest, CASE WHEN two.digest IS NULL THEN 2 END AS gone FROM one FULL JOIN two USING (doc_id)),
third AS (SELECT doc_id, coalesce(n.digest, b.digest) AS digest, n.digest IS NOT NULL AS here, b.digest IS NOT NULL AND b.gone IS NULL AS alive, b.digest AS was, b.gone FROM three AS n FULL JOIN second AS b USING (doc_id))
SELECT doc_id, digest, CASE WHEN here AND NOT alive THEN 'added' WHEN here AND digest = was THEN 'unchanged' WHEN here THEN 'changed' WHEN alive THEN 'removed' ELSE 'tombstone' END AS change, CASE WHEN NOT here THEN coalesce(gone, 3)::BIGINT END AS deleted_at
FROM third WHERE here OR coalesce(gone, 3) >= 2""")
def incremental_ingest_batches(spark, sf_dir):
    """Three states of a corpus in turn: added, changed, unchanged, removed, and tombstones of what went before."""
    docs = tables.table(spark, sf_dir, "documents")
    digest = F.sha2("text", 256)
    renewed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat(F.lit("new"), F.col("text")), 256)).otherwise(digest)
    batches = [docs.where("doc_id % 3 <> 0").select("doc_id", digest.alias("digest")), docs.where("doc_id % 3 <> 1").select("doc_id", renewed.alias("digest")), docs.where("doc_id % 3 <> 1 AND doc_id % 7 <> 0 OR doc_id % 33 = 1").select("doc_id", renewed.alias("digest"))]
    state = batches[0].limit(0).withColumn("deleted_at", F.lit(None).cast("long"))
    for n, now in enumerate(batches, 1):
        state = governance.next_state(now, state, "doc_id", "digest", F.lit(n).cast("long"), F.lit(n - 1).cast("long"))
    return state


@query("""SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 6 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS reuse FROM documents""")
def snapshot_reuse(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    at = lambda n, value, other: F.when(F.col("doc_id") % n == 0, other).otherwise(value)
    same = [(F.sha2("text", 256), at(5, F.sha2("text", 256), F.lit("other"))), (F.lit("f1"), at(6, F.lit("f1"), F.lit(None))), (F.lit(3), at(11, F.lit(3), F.lit(2)))]
    chunks = F.expr("CASE WHEN doc_id % 13 = 0 THEN CAST(array() AS array<string>) ELSE array('c1') END")
    return docs.select("doc_id", governance.reusable(at(4, F.lit("completed"), F.lit("failed")), same, chunks).alias("reuse"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'doc-' || doc_id ELSE '' END AS document_id, CASE WHEN doc_id % 8 = 0 THEN 'doc-' || doc_id END AS other FROM documents)
SELECT doc_id FROM r WHERE coalesce(nullif(document_id, ''), other) IS NOT NULL AND (doc_id % 3 <> 0 OR doc_id % 5 IN (1, 2))""")
def response_access_filter(spark, sf_dir):
    """References of a response that its reader may see; the document is named in one of two columns."""
    docs = tables.documents(spark, sf_dir)
    allowed = governance.allowed(tables.access(docs), "someone", ["r1", "r2"], []).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    refs = docs.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("document_id")).otherwise("").alias("document_id"), F.when(F.col("doc_id") % 8 == 0, F.col("document_id")).alias("other"))
    return governance.visible(refs, allowed, "document_id", "other").select("doc_id")


@query("""WITH e AS (SELECT 'customer-' || c_custkey AS source, 'doc-' || c_custkey % 40 AS document_id FROM customer)
SELECT source FROM e WHERE CAST(substring(document_id, 5) AS INT) % 3 <> 0 OR CAST(substring(document_id, 5) AS INT) % 5 IN (1, 2)""")
def graph_edge_access(spark, sf_dir):
    """Edges of documents that the reader may see."""
    docs = tables.documents(spark, sf_dir)
    allowed = governance.allowed(tables.access(docs), "someone", ["r1", "r2"], []).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    edges = tables.table(spark, sf_dir, "customer").selectExpr("'customer-' || c_custkey AS source", "'doc-' || c_custkey % 40 AS document_id")
    return governance.visible(edges, allowed).select("source")


@query("""WITH r AS (SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}') AS record_hash FROM part),
s AS (SELECT record_hash, min(p_partkey) AS vector FROM r WHERE p_partkey % 3 = 0 GROUP BY record_hash)
SELECT p_partkey, record_hash, vector FROM r LEFT JOIN s USING (record_hash)""")
def graph_record_reuse(spark, sf_dir):
    """Records whose content some stored record had under the same fingerprint."""
    part = tables.table(spark, sf_dir, "part")
    fields = ["p_brand", "p_type"]
    stored = governance.record_reuse(part, part.limit(0).selectExpr("'' AS record_hash", "'' AS fingerprint", "p_partkey", "p_partkey AS vector"), "p_partkey", fields, "f").drop("vector")
    stored = stored.select("record_hash", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "f").otherwise("old").alias("fingerprint"), F.col("p_partkey").alias("vector"))
    return governance.record_reuse(part, stored, "p_partkey", fields, "f").select("p_partkey", "record_hash", "vector")


@query("SELECT o_custkey AS document_id, 'missing_source' AS warning FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate <= DATE '1995-01-01' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def missing_registered(spark, sf_dir):
    found = tables.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"))
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 2 == 0).alias("automatic"), F.col("o_orderdate").alias("registered_at"))
    return governance.missing_registered(rows, found, F.lit("1995-01-01").cast("date"))
