"""Queries of access, versions, fingerprints, logs and audit chains, of sessions, and of Spark's own relational operators."""

from __future__ import annotations

from fathom.functions import canonical
from fathom.operators import governance
from fathom.session import cut, shared_path
from fathom.sources import tables
from fathom.sources.store import Store
from fathom.streaming import sessions
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import query

_OK = "doc_id % 3 <> 0 OR doc_id % 5 IN (1, 2)"
_VERSION = """version AS (SELECT 'doc-' || o_custkey AS document_id, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'retired' END AS status, o_orderdate AS effective_at FROM orders)"""


def _allowed(spark, sf_dir):
    return governance.allowed(tables.access(tables.documents(spark, sf_dir)), "someone", ["r1", "r2"], [])


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'public' ELSE 'restricted' END AS visibility FROM documents WHERE {_OK}")
def acl_allowed_documents(spark, sf_dir):
    return _allowed(spark, sf_dir).select("doc_id", "visibility")


@query(f"""WITH {_VERSION}, last AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY effective_at DESC, version DESC) AS n FROM version WHERE status IN ('published', 'retired') AND effective_at <= TIMESTAMP '1998-01-01')
SELECT document_id, version, effective_at FROM last WHERE n = 1 AND status = 'published'""")
def active_versions(spark, sf_dir):
    return governance.active_versions(tables.versions(spark, sf_dir), F.expr("timestamp'1998-01-01'"), "version")


@query(f"WITH {_VERSION} SELECT min(effective_at) AS next_activation_at FROM version WHERE status IN ('published', 'retired') AND effective_at > TIMESTAMP '1998-01-01'")
def next_activation(spark, sf_dir):
    return governance.next_activation(tables.versions(spark, sf_dir), F.expr("timestamp'1998-01-01'"))


@query(f"WITH {_VERSION} SELECT document_id, effective_at, count(*) AS n FROM version WHERE status IN ('published', 'retired') GROUP BY ALL HAVING count(*) > 1")
def version_conflicts(spark, sf_dir):
    return governance.version_conflicts(tables.versions(spark, sf_dir))


ROOTS = ["/kb", "/kb/en", "/kb/en/src1", "/kb/fr", "/other"]


@query(f"""SELECT doc_id, path, root FROM (SELECT doc_id, path, root, row_number() OVER (PARTITION BY doc_id ORDER BY length(root) DESC) AS n
FROM (SELECT doc_id, '/kb/' || lang || '/' || source || '.txt' AS path FROM documents) LEFT JOIN (VALUES {', '.join(f"('{r}')" for r in ROOTS)}) AS r(root) ON starts_with(path, root)) WHERE n = 1""")
def longest_root(spark, sf_dir):
    files = tables.documents(spark, sf_dir).select("doc_id", F.concat(F.lit("/kb/"), "lang", F.lit("/"), "source_file").alias("path"))
    return governance.longest_root(files, spark.createDataFrame([(r,) for r in ROOTS], "root string"))


@query("""SELECT c_custkey, sha256('{"generation_id": "gen-' || c_nationkey % 3 || '", "groups": ["g' || c_nationkey || '"], "permission_revision": "' || c_custkey % 4 || '", "roles": [' ||
  CASE WHEN c_mktsegment < 'r' THEN '"' || c_mktsegment || '", "r"' ELSE '"r", "' || c_mktsegment || '"' END || '], "subject": "subject-' || c_custkey || '"}') AS fingerprint FROM customer""")
def permission_fingerprint(spark, sf_dir):
    """Customers as principals, with roles in any order, a revision and a generation."""
    customer = tables.table(spark, sf_dir, "customer")
    said = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    hashed = governance.permission_fingerprint(customer, said("subject-", key), F.array(F.lit("r"), "c_mktsegment"), F.array(said("g", nation)), (key % 4).cast("string"), said("gen-", nation % 3))
    return customer.select("c_custkey", hashed.alias("fingerprint"))


_RECORD = """e AS (
  SELECT event_type, CAST(ts AS DATE) AS day, event_id, event_id || ':' || props AS payload, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS sequence FROM events
),
c AS (
  SELECT event_type, day, event_id, sequence, payload, repeat('0', 64) AS previous_hash, sha256('1|' || repeat('0', 64) || '|' || sha256(payload)) AS record_hash FROM e WHERE sequence = 1
  UNION ALL
  SELECT e.event_type, e.day, e.event_id, e.sequence, e.payload, c.record_hash, sha256(e.sequence || '|' || c.record_hash || '|' || sha256(e.payload))
  FROM c JOIN e ON e.event_type = c.event_type AND e.day = c.day AND e.sequence = c.sequence + 1
)"""
_LOG = ["event_type", "day"]


def _logged(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "props").alias("payload"))


def _records(spark, sf_dir):
    """A log a type of event and day, as chained records."""
    return governance.chain(_logged(spark, sf_dir), ["event_id"], F.col("payload"), _LOG)


@query(f"WITH RECURSIVE {_RECORD} SELECT event_type, day, event_id, sequence, record_hash FROM c")
def audit_chain_append(spark, sf_dir):
    """The same logs written in three parts, each behind the anchor of the one before."""
    events, log, ends = _logged(spark, sf_dir), None, None
    last = F.lit(events.agg(F.max("event_id")).first()[0])
    for low, high in ((0, 0.5), (0.5, 0.8), (0.8, 1)):
        part = events.where((F.col("event_id") > low * last) & (F.col("event_id") <= high * last) if low else F.col("event_id") <= high * last)
        if log is None:
            log = cut(governance.chain(part, ["event_id"], F.col("payload"), _LOG))
            ends = governance.anchors(log, _LOG)
        else:
            new, ends = governance.append(log, ends, part, ["event_id"], F.col("payload"), _LOG)
            log = log.unionByName(new)
    return log.select("event_type", "day", "event_id", "sequence", "record_hash")


@query(f"WITH RECURSIVE {_RECORD} SELECT event_type, day, event_id, sequence, record_hash FROM c")
def audit_chain(spark, sf_dir):
    return _records(spark, sf_dir).select("event_type", "day", "event_id", "sequence", "record_hash")


@query(f"""WITH RECURSIVE {_RECORD},
anchor AS (SELECT event_type, day, count(*) AS record_count, max_by(record_hash, sequence) AS last_hash FROM c GROUP BY ALL),
kept AS (SELECT *, sha256(sequence || '|' || previous_hash || '|' || sha256(payload || CASE WHEN event_id % 400 = 7 THEN 'x' ELSE '' END)) AS again FROM c WHERE event_id % 600 <> 11),
seen AS (SELECT *, row_number() OVER w AS n, coalesce(lag(again) OVER w, repeat('0', 64)) AS before FROM kept WINDOW w AS (PARTITION BY event_type, day ORDER BY sequence)),
found AS (SELECT event_type, day, count(*) AS records, count(*) FILTER (WHERE sequence <> n OR previous_hash <> before OR record_hash <> again) AS broken, max_by(again, sequence) AS last FROM seen GROUP BY ALL)
SELECT event_type, day, coalesce(records, 0) AS records, coalesce(broken, 0) AS broken, coalesce(broken, 0) = 0 AND records IS NOT DISTINCT FROM record_count AND last IS NOT DISTINCT FROM last_hash AS valid
FROM found FULL JOIN anchor USING (event_type, day)""")
def audit_chain_verify(spark, sf_dir):
    """Logs of which some records were changed and some are missing: their chains are found broken, others valid."""
    records = _records(spark, sf_dir)
    changed = F.concat("payload", F.when(F.col("event_id") % 400 == 7, "x").otherwise(""))
    return governance.verify_chain(records.where("event_id % 600 <> 11").withColumn("payload", changed), governance.anchors(records, _LOG), F.col("payload"), _LOG)


@query("SELECT c_custkey, '[REDACTED]' AS api_token, '[REDACTED]' AS prompt_text, c_name AS name, '[REDACTED]' AS body, c_mktsegment AS key, '[REDACTED]' AS user_question FROM customer")
def redact_details(spark, sf_dir):
    """Details with sensitive keys at several depths of structs, arrays and maps."""
    inner = F.struct(F.col("c_phone").alias("Prompt-Text"), F.col("c_name").alias("name")) if "c_phone" in tables.table(spark, sf_dir, "customer").columns else F.struct(F.col("c_mktsegment").alias("Prompt-Text"), F.col("c_name").alias("name"))
    parts = F.array(F.struct(F.col("c_name").alias("body"), F.col("c_mktsegment").alias("key")))
    details = F.struct(F.col("c_mktsegment").alias("api_token"), inner.alias("inner"), parts.alias("parts"), F.create_map(F.lit("User-Question"), F.col("c_name")).alias("more"))
    rows = tables.table(spark, sf_dir, "customer").select("c_custkey", details.alias("d"))
    d = rows.select("c_custkey", governance.redacted(F.col("d"), rows.schema["d"].dataType).alias("d"))
    part = F.get("d.parts", F.lit(0))
    return d.select("c_custkey", F.col("d.api_token").alias("api_token"), F.col("d.inner")["Prompt-Text"].alias("prompt_text"), F.col("d.inner")["name"].alias("name"), part["body"].alias("body"), part["key"].alias("key"), F.col("d.more")["User-Question"].alias("user_question"))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_recent_filtered(spark, sf_dir):
    errors = tables.table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts", "user_id")
    return errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query(f"SELECT source || '.txt' AS category, count(*) AS document_count FROM documents WHERE {_OK} GROUP BY source")
def category_acl_filter(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).join(_allowed(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return docs.groupBy(F.col("source_file").alias("category")).agg(F.count("*").alias("document_count"))


@query(f"""WITH {_VERSION} SELECT version, sha256('{{"acl": {{"groups": [], "policy_ref": "", "revision": "' || version % 3 || '", "roles": ["r' || version % 5 || '"], "users": [], "visibility": "restricted"}}, "document_id": "' || document_id || '", "effective_at": "' ||
  strftime(effective_at, '%Y-%m-%d %H:%M:%S') || '", "knowledge_base_id": "", "path": "kb/' || document_id || '.txt", "status": "' || status || '", "updated_at": null, "version": "' || version || '"}}') AS revision_hash FROM version""")
def manifest_revision_hash(spark, sf_dir):
    """Orders as entries of a manifest, with all eight fields and nested rules of access."""
    none = F.array().cast("array<string>")
    number = F.col("version")
    acl = F.struct(F.lit("restricted").alias("visibility"), none.alias("users"), F.array(F.concat(F.lit("r"), (number % 5).cast("string"))).alias("roles"), none.alias("groups"), F.lit("").alias("policy_ref"), (number % 3).cast("string").alias("revision"))
    rows = tables.versions(spark, sf_dir).select(
        "document_id",
        number.cast("string").alias("version"),
        "status",
        F.date_format("effective_at", "yyyy-MM-dd HH:mm:ss").alias("effective_at"),
        F.lit(None).cast("string").alias("updated_at"),
        F.concat(F.lit("kb/"), "document_id", F.lit(".txt")).alias("path"),
        F.lit(None).cast("string").alias("knowledge_base_id"),
        acl.alias("acl"),
    )
    return rows.select(number.cast("long").alias("version"), governance.manifest_revision(rows).alias("revision_hash"))


@query("SELECT 'supplier-' || s_suppkey AS source, sha256('supplier-' || s_suppkey || '|located in|nation-' || s_nationkey) AS record_hash FROM supplier")
def graph_record_hash(spark, sf_dir):
    edges = tables.edges(spark, sf_dir).where("source_file = 'suppliers.txt'")
    return edges.select("source", F.sha2(F.concat_ws("|", "source", "label", "target"), 256).alias("record_hash"))


@query("SELECT 'doc-' || p_partkey AS document_id, 1::BIGINT AS version, 'public' AS visibility, 'high' AS severity FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)")
def unlisted_file_registration(spark, sf_dir):
    """Files (a part each) that no manifest lists, registered as public first versions with a warning."""
    files = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("doc-"), F.col("p_partkey").cast("string")).alias("document_id"))
    return governance.register_unlisted(files, tables.versions(spark, sf_dir))


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, min(ts) AS started_at, count(*) AS turns FROM s GROUP BY user_id, n""")
def session_windows(spark, sf_dir):
    return sessions.session_counts(tables.table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "started_at", "turns")


@query("SELECT conv_id, turn, role, substring(text, 1, 600) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 8")
def session_history_last8(spark, sf_dir):
    return sessions.last_turns(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn", 8).select("conv_id", "turn", "role", F.substring("text", 1, 600).alias("text"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, sf_dir):
    return tables.table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01') ON o_custkey = c_custkey AND n = 1")
def asof_latest_order(spark, sf_dir):
    past = tables.table(spark, sf_dir, "orders").where("o_orderdate <= timestamp'1998-01-01'")
    last = past.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return tables.table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_active_customers(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_idle_customers(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT a.event_id, count(*) AS followed_by FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'error' GROUP BY a.event_id")
def range_join_events(spark, sf_dir):
    """Events of a user within an hour after an error: a range frame, so no pairs are made."""
    events = tables.table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    after = Window.partitionBy("user_id").orderBy("at").rangeBetween(1, 3_600_000_000)
    return events.withColumn("followed_by", F.count("*").over(after)).where("event_type = 'error' and followed_by > 0").select("event_id", "followed_by")


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_intersect_docs(spark, sf_dir):
    of = lambda s: tables.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O")).exceptAll(of("P").distinct())


@query()
def approx_distinct_users(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders")
def window_moving_sum(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("moving"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN 3 ELSE 1 END AS batch
FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
UNION ALL SELECT -1 - c_custkey, 'N', c_acctbal, 3 FROM customer""")
def store_upsert(spark, sf_dir):
    """Orders in a keyed store: all of them, then those of one status anew, then those of another, customers, and deletes."""
    store = Store(spark, shared_path(spark, "store"), ("o_orderkey",), 16)
    orders = tables.table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    rows = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("batch"))
    store.replace(rows)
    store.upsert(rows.where(status == "P").select("o_orderkey", F.lit("F").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), F.lit(2).alias("batch")))
    customers = tables.table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"), F.lit(3).alias("batch"))
    late = rows.where(status == "O").withColumn("batch", F.lit(3)).unionByName(customers)
    store.upsert(late, orders.where((status == "F") & (F.col("o_orderpriority") == "5-LOW")).select("o_orderkey"))
    return store.read()


@query("""SELECT o_custkey, sha256('{"customer":{"id":' || o_custkey || ',"name":null},"orders":[' || string_agg('{"key":' || o_orderkey || ',"lines":{"' || o_orderstatus || '":[' || o_orderkey || ',null]},"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}') AS fingerprint FROM orders GROUP BY o_custkey""")
def canonical_fingerprint(spark, sf_dir):
    """Customers with their orders as nested objects, whose keys come in any order."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    orders = tables.table(spark, sf_dir, "orders").select("o_custkey", key.alias("key"), status.alias("status"))
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("key", "status"))).alias("orders"))
    nested = F.transform("orders", lambda o: F.struct(o["status"].alias("status"), F.create_map(o["status"], F.array(o["key"], F.lit(None).cast("long"))).alias("lines"), o["key"].alias("key")))
    rows = listed.select("o_custkey", nested.alias("orders"), F.struct(F.lit(None).cast("string").alias("name"), F.col("o_custkey").alias("id")).alias("customer"))
    return rows.select("o_custkey", canonical.fingerprint(rows, "orders", "customer").alias("fingerprint"))
