"""Queries of text functions: cleaning, hashes, titles, terms, casts and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from fathom.functions import text as T
from fathom.sources import files, tables
from fathom.sources.make import docx as make_docx
from fathom.sources.make import pptx as make_pptx
from fathom.sources.make import xlsx as make_xlsx
from pyspark.sql import functions as F

from .registry import SQL, query

TITLES = ["v2.1 Billing rules 2024-05-01", "draft onboarding guide", "3 Access policy_20240131", "copy of Refund notes", "Retention manual", "plain"]
QUOTES = ['the "first term" and "second"', "no quotes", '"x" is short, "a longer quoted term" is not', "“curly quotes” and “curly quotes”"]
TERMS = ("token", "license", "License", "the", "eau")


def _values(rows: list[str]) -> str:
    return ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(rows))


def _literal(spark, rows: list[str]):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


@query(r"""
SELECT doc_id, sha256(c) AS content_hash, length(c) AS n_chars FROM (
  SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS c
  FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x{feff}\x{200b}]', '', 'g'), '\r\n?', chr(10), 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents))""")
def clean_text(spark, sf_dir):
    cleaned = tables.documents(spark, sf_dir).select("doc_id", T.clean(F.col("content")).alias("c"))
    return cleaned.select("doc_id", T.content_hash(F.col("c")).alias("content_hash"), F.length("c").cast("long").alias("n_chars"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.content_hash(F.col("content")).alias("content_hash"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS chunk_hash FROM documents")
def normalized_hash(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.normalized_hash(F.col("content")).alias("chunk_hash"))


@query(r"SELECT doc_id, substring(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g'), 1, 80) AS title FROM documents")
def section_title(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.section_title(F.col("content")).alias("title"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS detected FROM documents")
def language_detect(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.language(F.col("content")).alias("detected"))


@query(rf"""
WITH a AS (SELECT id, regexp_replace(text, '(?i)^v?\d+(?:\.\d+)*[ _-]+', '') AS c FROM (VALUES {_values(TITLES)}) AS v(id, text)),
b AS (SELECT id, regexp_replace(c, '[ _-]*\(?\d{{4}}[-_.]?\d{{2}}[-_.]?\d{{2}}\)?$', '') AS c FROM a),
d AS (SELECT id, regexp_replace(regexp_replace(c, '(?i)^(?:draft|copy of|final)[ _-]+', ''), '(?i)[ _-]+(?:guide|manual|notes)$', '') AS c FROM b)
SELECT id, regexp_replace(c, '^[ _-]+|[ _-]+$', '', 'g') AS topic FROM d""")
def title_topic_cleanup(spark, sf_dir):
    return _literal(spark, TITLES).select("id", T.title_topic(F.col("text")).alias("topic"))


@query(rf"""
SELECT id, coalesce(string_agg(t, '|' ORDER BY i), '') AS terms FROM (
  SELECT v.id, x.t, min(x.i) AS i FROM (VALUES {_values(QUOTES)}) AS v(id, text),
    LATERAL (SELECT unnest(regexp_extract_all(text, '["“「『《]([^"“”「」『』《》]{{2,30}})["”」』》]', 1)) AS t, generate_subscripts(regexp_extract_all(text, '["“「『《]([^"“”「」『』《》]{{2,30}})["”」』》]', 1), 1) AS i) AS x GROUP BY v.id, x.t)
GROUP BY id UNION ALL SELECT 1, ''""")
def quoted_terms(spark, sf_dir):
    return _literal(spark, QUOTES).select("id", F.array_join(T.quoted_terms(F.col("text")), "|").alias("terms"))


@query(r"SELECT doc_id, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(source || '.txt', '\.[A-Za-z0-9]+$', ''), '(?i)(?:document|file|guide|manual)', '', 'g'), '^[ _\-0-9]+|[ _\-0-9]+$', '', 'g'), 1, 16), ''), 'other') AS category FROM documents")
def file_category(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.file_category(F.col("source_file")).alias("category"))


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(repr(t) for t in TERMS)}], lambda t: contains(text, t)), ',') AS terms FROM documents")
def matched_terms(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", F.array_join(T.matched_terms(F.col("content"), TERMS), ",").alias("terms"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source_file":"' || source || '.txt"}') AS fingerprint FROM documents""")
def canonical_fingerprint(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", T.canonical_hash("source_file", "lang", "doc_id").alias("fingerprint"))


@query("SELECT o_orderkey, coalesce(try_cast(substring(o_orderpriority, 1, 1) AS DOUBLE), -1.0)::DOUBLE AS leading, coalesce(try_cast(o_orderpriority AS DOUBLE), -1.0)::DOUBLE AS whole FROM orders")
def safe_cast(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.safe_double(F.substring("o_orderpriority", 1, 1), -1.0).alias("leading"), T.safe_double(F.col("o_orderpriority"), -1.0).alias("whole"))


@query("""
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS label
FROM (SELECT event_id, event_id * 7 % 20000 AS s FROM events)""")
def duration_labels(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", T.duration_label(F.col("event_id") * 7 % 20000).alias("label"))


@query(r"SELECT conv_id, turn, regexp_replace(role || ' - turn ' || turn, '[^\pL\pN_]+', '_', 'g') AS slug FROM conversations")
def slugs(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.slug(F.concat("role", F.lit(" - turn "), F.col("turn").cast("string"))).alias("slug"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_salvage(spark, sf_dir):
    """The JSON object inside a free text."""
    said = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - done"))
    return tables.table(spark, sf_dir, "events").select("event_id", T.json_object(said, "k long")["k"].alias("k"))


@query()
def truncated_text(spark, sf_dir):
    """Texts cut to a budget of 60, with an ellipsis; tests compare with a loop."""
    return tables.documents(spark, sf_dir).select("doc_id", T.truncated(F.col("content"), 60).alias("cut"))


@query("SELECT vec_id, 1 / (1 + exp(-greatest(least(embedding[1]::DOUBLE * 10, 50), -50))) AS relevance FROM embeddings")
def rerank_sigmoid(spark, sf_dir):
    from fathom.functions.vectors import sigmoid

    return tables.table(spark, sf_dir, "embeddings").select("vec_id", sigmoid(F.get("embedding", F.lit(0)).cast("double") * 10).alias("relevance"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding) AS dimension FROM embeddings")
def vector_norms(spark, sf_dir):
    from fathom.functions.vectors import norm, same_dimension

    vectors = tables.table(spark, sf_dir, "embeddings").withColumn("embedding", same_dimension(F.col("embedding"), 64))
    return vectors.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dimension"))


_CLEAN = SQL["clean_text"].split("FROM (", 1)[1].rstrip().removesuffix(")")


@query(f"""WITH cleaned AS ({_CLEAN}),
line AS (SELECT doc_id, string_split(c, chr(10)) AS ls FROM cleaned WHERE c <> ''),
said AS (
  SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN array_to_string(ls, chr(10))
    WHEN 1 THEN '工作表：Sheet' || chr(10) || array_to_string(list_transform(ls, lambda x: replace(x, ' ', ' | ')), chr(10))
    ELSE array_to_string(list_transform(list_zip(ls, range(1, len(ls) + 1)), lambda x: '幻灯片 ' || x[2] || chr(10) || x[1]), chr(10)) END AS content FROM line)
SELECT doc_id, CASE WHEN doc_id % 40 <> 39 THEN sha256(coalesce(content, '')) END AS content_hash, doc_id % 40 = 39 AS failed FROM documents LEFT JOIN said USING (doc_id)""")
def office_files(spark, sf_dir):
    """Documents as books of cells, texts of paragraphs and decks of slides, read again; some files are cut short."""
    suffix = F.element_at(F.array(*map(F.lit, ("docx", "xlsx", "pptx"))), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = tables.documents(spark, sf_dir).select("doc_id", suffix.alias("suffix"), T.clean(F.col("content")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {"docx": make_docx, "xlsx": lambda ls: make_xlsx([x.split(" ") for x in ls]), "pptx": make_pptx}
        kinds = pa.schema([("path", pa.string()), ("suffix", pa.string()), ("content", pa.binary())])
        for batch in batches:
            out, size = [], 0
            for doc_id, kind, text in zip(*batch.columns, strict=True):
                i, text = doc_id.as_py(), text.as_py()
                data = of[kind.as_py()](text.split("\n") if text else [])
                out.append({"path": str(i), "suffix": kind.as_py(), "content": data[: len(data) // 2] if i % 40 == 39 else data})
                size += len(data)
                if size > files.PORTION:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, kinds)

    made = docs.mapInArrow(make, "path string, suffix string, content binary")
    found = files.read(made.withColumn("file_hash", F.sha2("content", 256)))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.sha2("content", 256).alias("content_hash"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT l_orderkey, string_agg(p_name || chr(10) || chr(34) || p_brand || chr(34) || ' | ' || l_quantity, chr(10) ORDER BY l_linenumber, p_name, l_quantity, p_brand) AS content
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def csv_records(spark, sf_dir):
    """Orders as tables whose quoted cells have line ends and quotes."""
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").alias("p_partkey"))
    parts = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    row = F.concat(F.lit('"'), "p_name", F.lit('\n""'), "p_brand", F.lit('""", '), F.col("l_quantity").cast("string"), F.lit(", ,"))
    each = lines.join(parts, "p_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "l_quantity", row.alias("row")))).alias("rows"))
    return each.select("l_orderkey", files.csv_text(F.array_join(F.col("rows.row"), "\r\n")).alias("content"))
