"""Queries of the thirteen operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, html, jaccard, language, licenses, neardup, packing, search, secrets, sharding, token_files, toxicity
from .shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), sharding.tree_of(24), sharding.tree_of(25))
    return placed.withColumn("law", F.lit("key"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.col("secrets"), ("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


QUERIES |= {"op1_decontamination": op1_decontamination, "op2_license_scan": op2_license_scan}

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '{decontam.WORD}')"
ORACLE_SQL["op1_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS span
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i) WHERE len(ws) > 0
),
doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS span
  FROM doc, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i)
),
hit AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, span)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _wide(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _spelled_sql(lowered: str) -> str:
    out = f"' ' || trim(regexp_replace({lowered}, '{licenses.SEPARATORS}', '  ', 'g')) || ' '"
    for old, new in licenses.SPELLINGS.items():
        out = f"replace({out}, '{_wide(old)}', '{_wide(new)}')"
    return f"replace({out}, '  ', ' ')"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
    return f"trim({_spelled_sql(out)})"


# The notices of the bare form, line by line, as the patterns of SQL look neither ahead nor behind.
_SIGNED = r"^[ \t]*(copyright[ \t:,]*(\(c\)|©|[12][0-9]{3}|[\[<{](yyyy|year))|\(c\)[ \t]*(copyright|[12][0-9]{3}|[\[<{])|©)"
_RESERVED = r"^[ \t]*all rights reserved\.?[ \t\r]*$"
_HEADED, _OTHERWISE = r"^[ \t]*copyright[ \t]+", r"^[ \t]*copyright[ \t]+(notice|holder|owner|law|licen|and |or )"
_BLANK = r"^[ \t\r]{0,8}$"


def _bare(text: str) -> str:
    """The bare form in plain Python, for the digests of the licences known."""
    lines = text.lower().split("\n")
    kept = []
    for i, x in enumerate(lines):
        head = i == 0 or (i > 1 and re.search(_BLANK, lines[i - 1]))
        if not (re.search(_SIGNED, x) or re.search(_RESERVED, x) or (head and re.search(_HEADED, x) and not re.search(_OTHERWISE, x))):
            kept.append(x)
    words = re.sub(licenses.LIST_MARK, " ", "\n".join(kept))
    out = f" {re.sub('[^a-z0-9\x80-\U0010ffff]+', '  ', words).strip(' ')} "
    for old, new in licenses.SPELLINGS.items():
        out = out.replace(_wide(old), _wide(new))
    return re.sub(licenses.HOLDER_NAME, _ANY_HOLDER, out.replace("  ", " ")).strip(" ")


_ANY_HOLDER = " neither the name of the copyright owner nor the names of its contributors may "


def _bare_sql(text: str) -> str:
    """The same for a column."""
    lines = f"string_split(lower({text}), chr(10))"
    head = f"x[2] = 1 OR (x[2] > 2 AND regexp_matches(x[3], '{_BLANK}'))"
    notice = f"regexp_matches(x[1], '{_SIGNED}') OR regexp_matches(x[1], '{_RESERVED}') OR (({head}) AND regexp_matches(x[1], '{_HEADED}') AND NOT regexp_matches(x[1], '{_OTHERWISE}'))"
    kept = f"array_to_string(list_transform(list_filter(list_zip({lines}, range(1, len({lines}) + 1), list_concat([''], {lines})[:-2]), lambda x: NOT ({notice})), lambda x: x[1]), chr(10))"
    marked = f"regexp_replace({kept}, '{licenses.LIST_MARK}', ' ', 'g')"
    return f"trim(regexp_replace({_spelled_sql(marked)}, '{licenses.HOLDER_NAME}', '{_ANY_HOLDER}', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.KNOWN.items())
    laid = {}
    for name, body in licenses.full_texts():
        digest = hashlib.sha256(_bare(body).encode()).hexdigest()
        laid[digest] = min(name, laid.get(digest, name))
    bare = ", ".join(f"('{d}', {_quoted(n)})" for d, n in sorted(laid.items()))
    return f"""
WITH known AS (SELECT sha256({_canonical_sql("body")}) AS digest, min(license) AS license FROM (VALUES {known}) AS k(license, body) GROUP BY 1),
laid(bare, full_license) AS (VALUES {bare}),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS row, text FROM documents)),
named AS (
  SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT row, sha256({_canonical_sql("line")}) AS digest FROM lines WHERE regexp_matches(lower(line), 'licen[cs]e')) JOIN known USING (digest) GROUP BY row
),
doc AS (SELECT row_number() OVER () AS row, doc_id, sha256({_canonical_sql("text")}) AS digest, CASE WHEN regexp_matches(lower(text), 'licen[cs]e|copyright|permission|redistribution|warrant') THEN sha256({_bare_sql("text")}) END AS bare FROM documents)
SELECT d.doc_id, d.digest, coalesce(k.license, l.full_license) AS license, coalesce(n.notices, '') AS notices
FROM doc AS d LEFT JOIN known AS k USING (digest) LEFT JOIN laid AS l USING (bare) LEFT JOIN named AS n USING (row)
"""


ORACLE_SQL["op2_license_scan"] = _license_sql()


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(_table(spark, sf_dir, "documents"))


QUERIES["op6_ngram_jaccard"] = op6_ngram_jaccard
ORACLE_SQL["op6_ngram_jaccard"] = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
member AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s
  FROM doc, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0
),
size AS (SELECT doc_id, count(*) AS n FROM member GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM member AS a JOIN member AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size AS p ON p.doc_id = a.doc_id JOIN size AS q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
),
reached AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, y FROM reached AS r JOIN link ON link.x = r.c)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, r.component_id
FROM doc AS d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id) AS r USING (doc_id)
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES |= {"op5_html_extraction": op5_html_extraction, "op7_embedding_near_dup": op7_embedding_near_dup}
ORACLE_SQL["op7_embedding_near_dup"] = """
WITH RECURSIVE vec AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vec AS a JOIN vec AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, y FROM reached AS r JOIN link ON link.x = r.c)
SELECT vec_id, (SELECT count(*) FROM link WHERE x = vec_id) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM reached GROUP BY vec_id
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def _codes_sql(s: codes.Settings) -> str:
    """Every round is an assignment of all parts and a new codebook, one common table each."""
    floor = "(s - ((s % n) + n) % n) // n"
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
part AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * len(v) // {s.parts} + 1, (p + 1) * len(v) // {s.parts}) AS x FROM kept, (SELECT unnest(range({s.parts})) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {s.entries}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN first USING (vec_id)),"""
    for r in range(s.rounds + 1):
        sql += f"""
apart{r} AS (SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM part JOIN book{r} USING (p)),
near{r} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS m FROM apart{r} GROUP BY vec_id, p),"""
        if r < s.rounds:
            sql += f"""
cell{r} AS (SELECT p, m.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM part JOIN near{r} USING (vec_id, p)),
mean{r} AS (SELECT p, e, i, CAST({floor} AS BIGINT) AS y FROM (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM cell{r} GROUP BY p, e, i)),
moved{r} AS (SELECT p, e, list(y ORDER BY i) AS c FROM mean{r} GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} AS b LEFT JOIN moved{r} AS m ON m.p = b.p AND m.e = b.e),"""
    return f"""{sql}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{s.rounds} GROUP BY vec_id
),
named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{s.rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), named
"""


QUERIES["op13_vector_codes"] = op13_vector_codes
ORACLE_SQL["op13_vector_codes"] = _codes_sql(codes.Settings())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op11_ranked_search"] = op11_ranked_search
ORACLE_SQL["op11_ranked_search"] = f"""
WITH word AS (SELECT doc_id, row_number() OVER () AS d, {_WORDS} AS ws FROM documents),
size AS (SELECT d, doc_id, CAST(len(ws) AS BIGINT) AS n FROM word WHERE len(ws) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
tf AS (SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(ws) AS term FROM word) GROUP BY d, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
asked AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (d), whole GROUP BY item_id, d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN size USING (d) WHERE score > 0 QUALIFY rank <= 10
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES["op12_language_id"] = op12_language_id
