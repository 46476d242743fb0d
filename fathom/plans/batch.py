"""Queries for a table of questions: the first turns of all conversations."""

from __future__ import annotations

from fathom.operators import batch, evaluation, governance, index
from fathom.params import LATIN, RetrievalSettings, evaluation_profiles
from fathom.session import cut, shared_path
from fathom.sources import tables
from pyspark.sql import functions as F

from . import evidence
from .registry import SQL, query

SETTINGS = RetrievalSettings(top_k=3, min_score=0.3, candidate_k=20)
#: All profiles, those without near copies, and the rest, which ``tool_batch`` shows.
EVERY = evaluation_profiles(SETTINGS)
PROFILES = {name: s for name, s in EVERY.items() if not s.dedup_enabled}


def _questions(spark, sf_dir):
    """First turns with the vector of their number, three words as entities, and terms."""
    said = tables.table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    said = said.join(tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query")), "question_id")
    words = lambda pattern, n: F.slice(F.array_distinct(F.regexp_extract_all("question", F.lit(pattern), F.lit(0))), 1, n)
    number = F.col("question_id")
    return said.withColumns(
        {
            "category": F.concat(F.lit("c"), (number % 10).cast("string")),
            "entities": words("[a-z]{4,}", 3),
            "terms": words("[a-z]{3,}", 5),
            "files": F.array(F.concat(F.lit("src"), (number % 20).cast("string"), F.lit(".txt"))),
            "mode": F.when(F.length("question") >= 120, "hybrid").otherwise("vector"),
        }
    )


def _settings(questions, profiles=PROFILES):
    return batch.question_settings(profiles, questions, LATIN)


_ASK = """
ask AS MATERIALIZED (SELECT conv_id AS q, text, embedding::DOUBLE[] AS query, 'c' || conv_id % 10 AS want, 'src' || conv_id % 20 || '.txt' AS file, length(text) >= 120 AS hybrid,
  list_slice({}, 1, 3) AS entities, list_slice({}, 1, 5) AS terms
  FROM conversations JOIN embeddings ON vec_id = conv_id WHERE turn = 0)""".format(
    *(f"list_transform(list_filter(list_zip({w}, range(1, len({w}) + 1)), lambda x: list_position({w}, x[1]) = x[2]), lambda x: x[1])" for w in ("regexp_extract_all(text, '[a-z]{4,}')", "regexp_extract_all(text, '[a-z]{3,}')"))
)
_UNIT = """
unit AS MATERIALIZED (
  SELECT doc_id, embedding::DOUBLE[] AS embedding, 'c' || label AS category, 'u' || doc_id AS chunk_id, 'grp-' || doc_id % 40 AS document_id, CASE WHEN doc_id % 7 <> 0 THEN 'up' || doc_id % 80 END AS parent,
    doc_id % 2 = 0 AS child, source || '.txt' AS source_file, text AS content FROM embeddings JOIN documents ON doc_id = vec_id)"""
_COSINE = "greatest(0, coalesce(list_cosine_similarity(embedding, query), 0))"
_POINTS = "0.65 * v + 0.20 * (category = want)::INT + 0.10 * CASE WHEN len(entities) > 0 THEN len(list_filter(entities, lambda e: contains(content, e))) / len(entities) ELSE 0 END + 0.05 * (source_file = file)::INT"


@query(f"""WITH {_ASK}, {_UNIT},
near AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY {_COSINE} DESC, chunk_id) AS n, {_COSINE} AS v, {_POINTS.replace(' v ', f' {_COSINE} ')} AS s FROM ask, unit QUALIFY n <= 20)
SELECT q AS question_id, 'u' || doc_id AS chunk_id, round(v, 6) AS vector_score, round(s, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY s DESC, v DESC, 'u' || doc_id) AS pos FROM near WHERE s >= 0.3""")
def vector_batch(spark, sf_dir):
    """The best chunks of every question by vector and rescored, with one product a block of questions."""
    questions = _questions(spark, sf_dir)
    plain = batch.question_settings({"one": SETTINGS}, questions, LATIN)
    found = batch.vector_batch(evidence._units(spark, sf_dir), questions, plain)
    return found.select("question_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), F.round("score", 6).alias("score"), "pos")


@query(f"""WITH {_ASK}, {_UNIT},
scored AS (SELECT q, chunk_id, 0.45 + 0.2 * (category = want)::INT + least(0.3, 0.08 * len(list_filter(terms, lambda t: contains(content, t)))) + 0.05 * (source_file = file)::INT AS s FROM ask, unit)
SELECT q AS question_id, chunk_id, round(s, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, chunk_id) AS pos FROM scored QUALIFY pos <= 20""")
def keyword_batch(spark, sf_dir):
    """The best chunks of every question by category, file and its own terms, which are all looked for in one walk."""
    found = batch.keyword_batch(evidence._units(spark, sf_dir), _questions(spark, sf_dir), 20)
    return found.withColumn("score", F.round("score", 6))


_HITS = "list_sum(list_transform(terms, lambda t: (length(content) - length(replace(content, t, ''))) // length(t)))"


@query(f"""WITH {_ASK}, {_UNIT},
scored AS (SELECT q, chunk_id, least(1, 0.35 + 0.08 * {_HITS}) AS s FROM ask, unit WHERE {_HITS} > 0)
SELECT q AS question_id, chunk_id, round(s, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, chunk_id) AS pos FROM scored QUALIFY pos <= 20""")
def term_batch(spark, sf_dir):
    """The best chunks of every question by how often they have its terms."""
    found = batch.term_batch(evidence._units(spark, sf_dir), _questions(spark, sf_dir), 20)
    return found.withColumn("score", F.round("score", 6))


_K = "least(10, top_k + CASE WHEN dynamic THEN least(2, (length(text) >= 36)::INT + ({clauses} >= 2)::INT + ({needs} >= 3)::INT) ELSE 0 END)".format(
    clauses=" + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in LATIN.clause_signals),
    needs=" + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in LATIN.requirement_signals),
)
_PROFILE, _EVERY = ("profile(profile, top_k, candidate_k, dynamic, parents, units) AS (VALUES " + ", ".join(f"('{n}', {s.top_k}, {s.candidate_k}, {s.dynamic_top_k_enabled}, {s.parent_context_enabled}, {s.multi_vector_enabled})" for n, s in ps.items()) + ")" for ps in (PROFILES, EVERY))
_SWEEP = f"""{_ASK}, {_UNIT}, {_PROFILE},
setting AS (SELECT *, greatest(4 * k, candidate_k) AS c FROM (SELECT profile, q, hybrid, candidate_k, parents, units, {_K} AS k FROM profile, ask)),
pair AS MATERIALIZED (SELECT q, u.*, {_COSINE} AS v, {_POINTS.replace(' v ', f' {_COSINE} ')} AS s, coalesce({_HITS}, 0) AS hits FROM ask, unit AS u),
seen AS (SELECT profile, q, hybrid, k, c, parents, doc_id, chunk_id, v, s, hits FROM setting JOIN pair USING (q) WHERE units OR NOT child),
near AS (SELECT *, row_number() OVER (PARTITION BY profile, q ORDER BY v DESC, chunk_id) AS n FROM seen QUALIFY n <= c),
vector AS (SELECT *, row_number() OVER (PARTITION BY profile, q ORDER BY s DESC, v DESC, chunk_id) AS pos FROM near WHERE s >= 0.3),
word AS (SELECT *, least(1, 0.35 + 0.08 * hits) AS w, row_number() OVER (PARTITION BY profile, q ORDER BY round(least(1, 0.35 + 0.08 * hits), 9) DESC, chunk_id) AS pos FROM seen WHERE hits > 0 AND hybrid QUALIFY pos <= c),
turn AS (
  SELECT profile, q, k, c, parents, doc_id, chunk_id, s AS score, pos, 0 AS stream FROM vector WHERE NOT hybrid OR pos <= k
  UNION ALL SELECT profile, q, k, c, parents, doc_id, chunk_id, w, pos, 1 FROM word),
once AS (SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY profile, q, chunk_id ORDER BY pos, stream) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY profile, q ORDER BY pos, stream) AS ord FROM once QUALIFY ord <= c),
grown AS (
  SELECT m.*, u.document_id, u.source_file, m.parents AND u.child AND p.doc_id IS NOT NULL AS up, CASE WHEN up THEN u.parent ELSE m.chunk_id END AS final, p.source_file AS parent_file
  FROM merged AS m JOIN unit AS u USING (doc_id) LEFT JOIN unit AS p ON 'up' || p.doc_id = u.parent AND p.document_id = u.document_id),
whole AS (SELECT *, min(ord) OVER (PARTITION BY profile, q, final) AS first_ord FROM grown QUALIFY row_number() OVER (PARTITION BY profile, q, final ORDER BY score DESC, ord) = 1),
hit AS (SELECT *, row_number() OVER (PARTITION BY profile, q ORDER BY first_ord) AS final_pos FROM whole QUALIFY final_pos <= k)"""


# The fold of near copies: the hits of a document in order, one a step, each beside the texts that nearly repeat its own.
_FOLD = f"""
fold AS MATERIALIZED (
  SELECT *, CASE WHEN up THEN substr(final, 3)::BIGINT ELSE doc_id END AS said, CASE WHEN up THEN parent_file ELSE source_file END AS file, row_number() OVER (PARTITION BY profile, q, document_id ORDER BY first_ord) AS step
  FROM whole WHERE profile IN ({", ".join(f"'{n}'" for n, s in EVERY.items() if s.dedup_enabled)})),
plain AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents WHERE doc_id IN (SELECT said FROM fold)),
letters AS (SELECT doc_id, regexp_replace(t, '[^a-z0-9]', '', 'g') AS c, regexp_extract_all(t, '[a-z0-9]+') AS ws FROM plain),
gram AS MATERIALIZED (
  SELECT doc_id, list(g) AS gs FROM (
    SELECT doc_id, 'c:' || substring(c, i, 3) AS g FROM letters, LATERAL (SELECT unnest(range(1, greatest(length(c) - 2, 1) + 1)) AS i) WHERE length(c) > 0
    UNION SELECT doc_id, 'w:' || array_to_string(list_slice(ws, i, i + 1), ' ') FROM letters, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i) WHERE len(ws) > 0)
  GROUP BY doc_id),
repeats AS (
  SELECT a, list(b) AS copies FROM (SELECT DISTINCT x.said AS a, y.said AS b FROM fold AS x JOIN fold AS y USING (profile, q, document_id) WHERE x.step <> y.step) JOIN gram AS x ON x.doc_id = a JOIN gram AS y ON y.doc_id = b
  WHERE len(list_intersect(x.gs, y.gs)) / (len(x.gs) + len(y.gs) - len(list_intersect(x.gs, y.gs))) >= {SETTINGS.dedup_threshold} GROUP BY a),
beside AS MATERIALIZED (SELECT fold.*, coalesce(copies, []) AS copies FROM fold LEFT JOIN repeats ON a = said),
kept AS (
  SELECT profile, q, document_id, step, [{{'place': first_ord, 'said': said, 'file': file, 'score': score}}] AS held FROM beside WHERE step = 1
  UNION ALL
  SELECT profile, q, document_id, n.step, CASE
    WHEN coalesce(list_position(list_transform(held, lambda x: list_contains(n.copies, x.said)), TRUE), 0) = 0 THEN list_append(held, {{'place': n.first_ord, 'said': n.said, 'file': n.file, 'score': n.score}})
    ELSE list_transform(held, lambda x, i: CASE WHEN i = list_position(list_transform(held, lambda y: list_contains(n.copies, y.said)), TRUE) AND n.score > x.score THEN {{'place': x.place, 'said': n.said, 'file': n.file, 'score': n.score}} ELSE x END) END
  FROM kept JOIN beside AS n USING (profile, q, document_id) WHERE n.step = kept.step + 1),
last AS (SELECT profile, q, document_id, unnest(held) AS h FROM (SELECT * FROM kept QUALIFY step = max(step) OVER (PARTITION BY profile, q, document_id))),
found AS (
  SELECT profile, q, document_id, final_pos, score, CASE WHEN up THEN parent_file ELSE source_file END AS file FROM hit WHERE profile NOT IN (SELECT profile FROM fold)
  UNION ALL
  SELECT profile, q, document_id, row_number() OVER (PARTITION BY profile, q ORDER BY h.place) AS final_pos, h.score, h.file FROM last JOIN setting USING (profile, q) QUALIFY final_pos <= k)"""


def _tool(spark, sf_dir, profile=None, profiles=PROFILES):
    """Final hits under all profiles given, or one. Units are read by several searches, so they are joined once."""
    units, questions = cut(evidence._units(spark, sf_dir)), cut(_questions(spark, sf_dir))
    settings = _settings(questions, profiles)
    settings = cut(settings if profile is None else settings.where(F.col("profile") == profile))
    return batch.tool_batch(units, evidence._parents(units), questions, settings), questions, settings


@query(f"""WITH {_SWEEP}
SELECT profile, q AS question_id, final_pos AS pos, final AS chunk_id, document_id, CASE WHEN up THEN parent_file ELSE source_file END AS source_file, round(score, 6)::DOUBLE AS score, CASE WHEN up THEN chunk_id END AS matched_chunk_id FROM hit""")
def tool_batch(spark, sf_dir):
    """The final hits of every question under every profile, with parent context."""
    found = _tool(spark, sf_dir)[0]
    return found.select("profile", "question_id", "pos", "chunk_id", "document_id", "source_file", F.round("score", 6).alias("score"), "matched_chunk_id")


@query(f"""WITH RECURSIVE {_SWEEP.replace(_PROFILE, _EVERY)}, {_FOLD},
cited AS (SELECT profile, q, count(*) AS n, round_even(avg(score), 4) AS points, bool_or(found.file = ask.file) AS sourced,
    min(CASE WHEN document_id = 'grp-' || q % 40 THEN final_pos END) AS first, count(*) FILTER (WHERE document_id = 'grp-' || q % 40) AS relevant, bool_or(document_id = 'grp-' || q % 40 AND final_pos <= 5) AS recalled
  FROM found JOIN ask USING (q) GROUP BY profile, q),
judged AS (SELECT profile, q, coalesce(n, 0) AS n, coalesce(points, 0) AS points, coalesce(sourced, FALSE) AS sourced, first, coalesce(relevant, 0) AS relevant, coalesce(recalled, FALSE) AS recalled FROM setting LEFT JOIN cited USING (profile, q))
SELECT profile, count(*) AS question_count, round_even(avg((n > 0)::INT), 4) AS success_rate, round_even(avg(sourced::INT), 4) AS source_hit_rate, round_even(avg(n), 4) AS avg_reference_count, coalesce(round_even(avg(CASE WHEN points > 0 THEN points END), 4), 0) AS avg_reference_score,
  round_even(avg(recalled::INT), 4) AS recall_at_5, round_even(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 4) AS mrr_at_10, coalesce(round_even(sum(relevant) / nullif(sum(n), 0), 4), 0) AS citation_precision
FROM judged GROUP BY profile""")
def evaluation_sweep(spark, sf_dir):
    """Profiles x questions: every first turn under every profile, those without near copies, too, scored by the document
    group that it stands for."""
    hits, questions, settings = _tool(spark, sf_dir, profiles=EVERY)
    none = F.array().cast("array<string>")
    cases = questions.select(
        "question_id",
        none.alias("expected_chunks"),
        F.array(F.concat(F.lit("grp-"), (F.col("question_id") % 40).cast("string"))).alias("expected_documents"),
        F.col("files").alias("expected_sources"),
        none.alias("expected_modes"),
        none.alias("forbidden_documents"),
        F.lit(None).cast("array<string>").alias("allowed_documents"),
        F.lit(True).alias("expect_references"),
        F.lit(False).alias("expect_paths"),
        *[F.lit("").alias(c) for c in ("expected_intent", "intent", "error")],
        F.col("mode").alias("retrieval_mode"),
        F.lit(0).alias("relation_paths"),
        F.lit("found").alias("answer"),
        F.lit(0).alias("latency_ms"),
        F.lit(0).alias("model_calls"),
        F.array().cast("array<struct<node:string,enabled:boolean,fallback:boolean>>").alias("trace"),
    )
    scored = batch.sweep(hits, cases, settings, ["nothing found"])
    return evaluation.profile_summary(scored, ["profile"]).select("profile", "question_count", "success_rate", "source_hit_rate", "avg_reference_count", "avg_reference_score", "recall_at_5", "mrr_at_10", "citation_precision")


@query(f"""SELECT q.vec_id AS question_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS vector_score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS pos
FROM embeddings AS q, embeddings AS e WHERE q.vec_id % 50 = 0 AND (e.vec_id % 3 <> 0 OR e.vec_id % 5 IN (1, 2)) QUALIFY pos <= 10""")
def vector_index_search(spark, sf_dir):
    """The ten nearest of every fiftieth vector among those that a reader may see, from an inverted file, exactly."""
    rows, path = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), shared_path(spark, "vectors")
    index.build_vectors(rows, path)
    questions = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query"))
    rules = tables.access(rows.select(F.col("chunk_id").alias("doc_id")))
    allowed = governance.allowed(rules, "someone", ["r1", "r2"], []).select(F.col("doc_id").alias("chunk_id"))
    found = index.search_vectors(spark, path, questions, 10, probes=4, exact=True, allowed=allowed)
    return found.withColumn("vector_score", F.round("vector_score", 6))


def _postings(spark, sf_dir):
    units, path = evidence._units(spark, sf_dir), shared_path(spark, "postings")
    index.build_postings(units, path)
    return path, units, _questions(spark, sf_dir)


@query(SQL["keyword_batch"])
def keyword_index_search(spark, sf_dir):
    """``keyword_batch`` from postings."""
    found = index.keyword_index_search(spark, *_postings(spark, sf_dir), 20)
    return found.withColumn("score", F.round("score", 6))


@query(SQL["term_batch"])
def term_index_search(spark, sf_dir):
    """``term_batch`` from postings."""
    found = index.term_index_search(spark, *_postings(spark, sf_dir), 20)
    return found.withColumn("score", F.round("score", 6))
