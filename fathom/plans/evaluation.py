"""Queries of evaluation and routing."""

from __future__ import annotations

import re

from fathom.operators import corpus, evaluation, governance
from fathom.params import LATIN, LATIN_ROUTING
from fathom.sources import tables
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import query

# Cases and references are made of documents: ten documents a case, of which a case cites the first none to ten.
_NO_MATCH = ["no match"]
_LISTS = {
    "expected_chunks": ("case_id % 4 = 0", ["'c' || case_id * 10", "'m' || (case_id * 10 + 4)", "' '"]),
    "expected_documents": ("case_id % 4 < 2", ["'doc-' || (case_id * 10 + 1)", "'doc-' || (case_id * 10 + 2)"]),
    "expected_sources": ("case_id % 4 = 2", ["'src0'", "'src1.txt'"]),
    "expected_modes": ("case_id % 2 = 0", ["'vector'", "'hybrid'"]),
    "forbidden_documents": ("case_id % 9 = 0", ["'doc-' || (case_id * 10 + 2)"]),
}
_CASE_FIELDS = """case_id % 4 <> 3 AS expect_references, case_id % 6 = 0 AS expect_paths, 'i' || case_id % 3 AS intent, CASE WHEN case_id % 5 = 4 THEN '' ELSE 'i' || case_id % 2 END AS expected_intent,
  CASE case_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' ELSE 'hybrid' END AS retrieval_mode, case_id % 7 AS relation_paths, CASE case_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'sorry, no match' ELSE 'answer ' || case_id END AS answer,
  CASE WHEN case_id % 12 = 5 THEN 'timeout' END AS error, case_id * 37 % 997 AS latency_ms, case_id % 4 AS model_calls, case_id % 3 = 0 AS rewrites, case_id % 6 = 0 AS falls_back"""
_REFERENCE_FIELDS = """'c' || doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'm' || doc_id END AS matched_chunk_id, CASE WHEN doc_id % 6 <> 0 THEN 'doc-' || doc_id END AS document_id, length(text) % 89 / 89e0 AS score,
  CASE WHEN doc_id % 13 = 0 THEN doc_id % 2 = 0 END AS relevant, CASE WHEN doc_id % 3 <> 0 THEN length(text) % 23 <> 1 END AS acl_allowed, CASE WHEN doc_id % 5 <> 0 THEN length(text) % 29 <> 1 END AS is_active,
  CASE length(text) % 31 WHEN 0 THEN 'Retired' WHEN 1 THEN 'published' END AS status, source || '.txt' AS source_file"""


def _lists(opened: str, closed: str, none: str, allowed: str) -> str:
    made = [f"CASE WHEN {when} THEN {opened}{', '.join(items)}{closed} ELSE {none} END AS {name}" for name, (when, items) in _LISTS.items()]
    return ", ".join([*made, f"CASE WHEN case_id % 8 = 0 THEN {opened}'doc-' || (case_id * 10 + 1){closed} END AS {allowed}"])


_SHARE = lambda a, b: f"coalesce(round_even({a} / nullif({b}, 0), 4), 0)::DOUBLE"
_MEAN = lambda c: f"coalesce(round_even(avg({c}), 4), 0)::DOUBLE"
_RATE = lambda c: _SHARE(f"count(*) FILTER ({c})", "count(*)")
_MEASURES = f"""{_MEAN('recall')} AS recall_at_5, {_MEAN('reciprocal_rank')} AS mrr_at_10, {_SHARE('sum(relevant_count)', 'sum(reference_count)')} AS citation_precision, {_SHARE('count(*) FILTER (covered)', 'count(*) FILTER (expects)')} AS citation_coverage,
  {_SHARE('count(*) FILTER (unfounded)', 'count(*) FILTER (expects)')} AS no_evidence_answer_rate, {_SHARE('sum(acl_leaks)', 'sum(reference_count)')} AS acl_leakage_rate, {_SHARE('sum(invalid_leaks)', 'sum(reference_count)')} AS invalid_content_leakage_rate,
  CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95_latency_ms, CAST(sum(model_calls) AS BIGINT) AS model_call_count"""
_SCORE = "round_even(" + " + ".join(f"{w} * {c}" for c, w in evaluation.WEIGHTS.items()) + ", 4)::DOUBLE"
_SCORED = f"""
told AS (
  SELECT doc_id // 10 AS case_id, 'p' || doc_id // 10 % 5 AS profile FROM documents WHERE doc_id % 10 = 0),
kase AS (SELECT case_id, profile, {_CASE_FIELDS}, {_lists('[', ']', '[]', 'allowed_documents')} FROM told),
ref AS (SELECT doc_id // 10 AS case_id, doc_id % 10 AS rank, {_REFERENCE_FIELDS} FROM documents WHERE doc_id % 10 < doc_id // 10 % 11),
want AS (SELECT *, CASE WHEN len(expected_chunks) > 0 THEN [x FOR x IN ['chunk:' || trim(c) FOR c IN expected_chunks] IF x <> 'chunk:'] WHEN len(expected_documents) > 0 THEN ['document:' || d FOR d IN expected_documents]
  ELSE ['source:' || f FOR f IN expected_sources] END AS wanted FROM kase),
met AS (SELECT want.*, ref.* EXCLUDE (case_id), ref.rank IS NOT NULL AS there, list_filter(['chunk:' || chunk_id, 'chunk:' || matched_chunk_id, 'document:' || document_id, 'source:' || source_file], lambda x: x IS NOT NULL) AS ids
  FROM want LEFT JOIN ref USING (case_id)),
judged AS (SELECT *, coalesce(relevant, list_has_any(wanted, ids), FALSE) AS hit, coalesce(NOT acl_allowed, allowed_documents IS NOT NULL AND NOT coalesce(list_contains(allowed_documents, document_id), FALSE)) AS leak,
  NOT coalesce(is_active, TRUE) OR coalesce(lower(status) IN ('deleted', 'inactive', 'retired', 'tombstoned'), FALSE) OR coalesce(list_contains(forbidden_documents, document_id), FALSE) AS invalid,
  coalesce(len([e FOR e IN expected_sources IF contains(source_file, e) OR contains(e, source_file)]) > 0, FALSE) AS meets FROM met),
counted AS (
  SELECT case_id, any_value(COLUMNS(['profile', 'expect_references', 'expect_paths', 'intent', 'expected_intent', 'retrieval_mode', 'relation_paths', 'answer', 'latency_ms', 'model_calls', 'rewrites', 'falls_back', 'wanted', 'expected_modes', 'expected_sources'])),
    max(error) AS error, count(rank) AS reference_count, list_distinct(flatten(list(CASE WHEN rank < 5 THEN list_intersect(wanted, ids) ELSE [] END))) AS recalled, min(rank) FILTER (hit AND rank < 10) AS first, count(*) FILTER (there AND hit) AS relevant_count,
    count(*) FILTER (there AND leak) AS acl_leaks, count(*) FILTER (there AND invalid) AS invalid_leaks, count(DISTINCT source_file) AS source_count, coalesce(round_even(avg(score), 4), 0)::DOUBLE AS avg_reference_score, bool_or(meets) AS source_met FROM judged GROUP BY case_id),
flagged AS (SELECT *, contains(answer, 'no match') AS nothing, reference_count > 0 AS has_references, contains(answer, 'no match') OR reference_count = 0 AS fallback FROM counted),
scored AS (
  SELECT profile, case_id, expected_intent, intent, retrieval_mode, CASE WHEN expect_references THEN error IS NULL AND NOT fallback ELSE nothing AND NOT has_references END AS success, has_references, reference_count, avg_reference_score, source_count, latency_ms, fallback,
    length(answer) AS answer_length, expected_intent = '' OR intent = expected_intent AS intent_match, len(expected_modes) = 0 OR list_contains(expected_modes, retrieval_mode) AS retrieval_mode_match, len(expected_sources) = 0 OR source_met AS source_hit,
    NOT expect_paths OR relation_paths > 0 AS graph_path_hit, rewrites AND NOT falls_back AS context_rewrite_triggered, CASE WHEN expect_references THEN NOT fallback ELSE nothing AND NOT has_references END AS fallback_correct, error IS NOT NULL AS failed,
    CASE WHEN len(wanted) > 0 THEN len(recalled) / len(wanted) END AS recall, CASE WHEN len(wanted) > 0 THEN coalesce(1 / (first + 1), 0) END AS reciprocal_rank, expect_references AS expects, expect_references AND relevant_count > 0 AS covered,
    expect_references AND answer <> '' AND NOT has_references AS unfounded, relevant_count, acl_leaks, invalid_leaks, model_calls FROM flagged)"""
_SUMMED = f"""{_SCORED},
sums AS (SELECT profile, count(*) AS question_count, {_RATE('success')} AS success_rate, {_RATE('fallback')} AS fallback_rate, {_RATE('failed')} AS error_rate, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency_ms, {_MEAN('reference_count')} AS avg_reference_count,
  {_MEAN('CASE WHEN avg_reference_score > 0 THEN avg_reference_score END')} AS avg_reference_score, CAST(floor(avg(answer_length)) AS BIGINT) AS avg_answer_length, {_RATE('intent_match')} AS intent_match_rate, {_RATE('retrieval_mode_match')} AS retrieval_mode_match_rate,
  {_RATE('source_hit')} AS source_hit_rate, {_RATE('graph_path_hit')} AS graph_path_coverage, {_RATE('fallback_correct')} AS fallback_correct_rate, {_MEASURES} FROM scored GROUP BY profile),
prof AS (SELECT *, {_SCORE} AS quality_score FROM sums), base AS (SELECT * FROM prof WHERE profile = 'p0')"""
_TOP = "SELECT profile FROM prof ORDER BY quality_score DESC, success_rate DESC, fallback_correct_rate DESC, source_hit_rate DESC, graph_path_coverage DESC, avg_reference_score DESC, avg_latency_ms, profile LIMIT 1"
_FLAGS = ["success", "has_references", "reference_count", "avg_reference_score", "source_count", "latency_ms", "fallback", "answer_length", "intent_match", "retrieval_mode_match", "source_hit", "graph_path_hit", "context_rewrite_triggered", "fallback_correct"]


def _references(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").where("doc_id % 10 < doc_id div 10 % 11")
    return docs.selectExpr("doc_id div 10 AS case_id", "'p' || doc_id div 10 % 5 AS profile", "doc_id % 10 AS rank", *_split(_REFERENCE_FIELDS))


def _split(fields: str) -> list[str]:
    """The expressions of a list in which each has a name."""
    return re.findall(r"(.+? AS [a-z_]+)(?:, |$)", " ".join(fields.split()))


def _told(spark, sf_dir):
    told = tables.table(spark, sf_dir, "documents").where("doc_id % 10 = 0").selectExpr("doc_id div 10 AS case_id").withColumn("profile", F.expr("'p' || case_id % 5"))
    trace = "array(named_struct('node', 'retrieve', 'enabled', CAST(NULL AS BOOLEAN), 'fallback', CAST(NULL AS BOOLEAN)), named_struct('node', 'context_rewrite', 'enabled', case_id % 3 = 0, 'fallback', case_id % 6 = 0)) AS trace"
    return told.selectExpr("*", *_split(_CASE_FIELDS), *_split(_lists("array(", ")", "CAST(array() AS array<string>)", "allowed_documents")), trace)


def _cases(spark, sf_dir):
    return evaluation.score_cases(_told(spark, sf_dir), _references(spark, sf_dir), ["profile", "case_id"], _NO_MATCH)


def _profiles(spark, sf_dir):
    return evaluation.profile_summary(_cases(spark, sf_dir), ["profile"])


@query(f"WITH {_SCORED} SELECT profile, case_id, {', '.join(_FLAGS)}, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM scored")
def eval_case_flags(spark, sf_dir):
    return _cases(spark, sf_dir).select("profile", "case_id", *_FLAGS, *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank")])


@query(f"WITH {_SCORED} SELECT {_MEASURES} FROM scored")
def eval_quality_metrics(spark, sf_dir):
    return evaluation.quality_metrics(_cases(spark, sf_dir), [])


@query(f"WITH {_SUMMED} SELECT * FROM prof")
def eval_profile_summary(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query("WITH told AS (SELECT doc_id // 10 AS case_id FROM documents WHERE doc_id % 10 = 0) SELECT 'retrieve' AS node, count(*) AS activations, 0 AS fallbacks FROM told UNION ALL SELECT 'context_rewrite', count(*) FILTER (case_id % 3 = 0), count(*) FILTER (case_id % 6 = 0) FROM told")
def eval_trace_counts(spark, sf_dir):
    return evaluation.trace_counts(_told(spark, sf_dir), [])


@query(f"WITH {_SUMMED} SELECT prof.profile, {', '.join(f'prof.{c} - base.{c} AS {c}_delta' if c == 'avg_latency_ms' else f'round_even(prof.{c} - base.{c}, 4) AS {c}_delta' for c in evaluation.DELTAS)} FROM prof, base")
def eval_baseline_delta(spark, sf_dir):
    return evaluation.deltas(_profiles(spark, sf_dir), "profile")


@query(f"WITH {_SUMMED} {_TOP}")
def eval_best_profile(spark, sf_dir):
    return evaluation.best_profile(_profiles(spark, sf_dir), "profile").select("profile")


@query(f"""WITH {_SUMMED}, c AS (SELECT prof.profile, CASE WHEN prof.profile = 'p0' THEN ['baseline_reference'] ELSE list_filter([
  CASE WHEN prof.acl_leakage_rate <> 0 THEN 'acl_leakage_zero' END, CASE WHEN prof.invalid_content_leakage_rate <> 0 THEN 'invalid_content_leakage_zero' END,
  CASE WHEN prof.recall_at_5 + 1e-12 < base.recall_at_5 - 0.02 THEN 'recall_regression_within_limit' END, CASE WHEN prof.p95_latency_ms > base.p95_latency_ms * 1.2 + 1e-12 THEN 'p95_latency_within_limit' END,
  CASE WHEN prof.citation_precision + 1e-12 < base.citation_precision THEN 'citation_precision_non_regression' END, CASE WHEN prof.citation_coverage + 1e-12 < base.citation_coverage THEN 'citation_coverage_non_regression' END,
  CASE WHEN prof.no_evidence_answer_rate > base.no_evidence_answer_rate + 1e-12 THEN 'no_evidence_answer_non_regression' END,
  CASE WHEN NOT (prof.citation_precision > base.citation_precision + 1e-12 OR prof.citation_coverage > base.citation_coverage + 1e-12 OR prof.no_evidence_answer_rate + 1e-12 < base.no_evidence_answer_rate
    OR (base.citation_precision >= 1 - 1e-12 AND base.citation_coverage >= 1 - 1e-12 AND base.no_evidence_answer_rate <= 1e-12 AND (prof.recall_at_5 > base.recall_at_5 + 1e-12 OR prof.mrr_at_10 > base.mrr_at_10 + 1e-12))) THEN 'primary_quality_improved' END],
  lambda x: x IS NOT NULL) END AS f FROM prof, base)
SELECT profile, array_to_string(f, ',') AS reasons, CASE WHEN profile <> 'p0' THEN len(f) = 0 END AS passed FROM c""")
def eval_quality_gate(spark, sf_dir):
    return evaluation.gate(_profiles(spark, sf_dir), "profile").withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_SUMMED}, best AS ({_TOP}), f AS (SELECT *, unnest(list_filter([CASE WHEN NOT intent_match THEN 'intent_mismatch' END, CASE WHEN NOT fallback_correct THEN 'fallback_failure' END, CASE WHEN NOT graph_path_hit THEN 'graph_path_miss' END], lambda x: x IS NOT NULL)) AS failure
  FROM scored SEMI JOIN best USING (profile)) SELECT profile, case_id, failure FROM f""")
def eval_diagnostics(spark, sf_dir):
    """Cases of the best profile that failed, by what failed."""
    scored = _cases(spark, sf_dir)
    best = evaluation.best_profile(evaluation.profile_summary(scored, ["profile"]), "profile")
    return evaluation.diagnostics(scored, best, "profile").select("profile", "case_id", "failure")


@query("""WITH c AS (SELECT CASE WHEN conv_id % 50 = 0 THEN ' ' ELSE 'q' || conv_id // 2 END AS case_id, CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE text END AS question FROM conversations WHERE turn = 0),
g AS (SELECT trim(case_id) AS case_id, count(*) AS n, bool_or(trim(question) = '') AS mute FROM c GROUP BY trim(case_id))
SELECT case_id, 'case without id' AS problem FROM g WHERE case_id = '' UNION ALL SELECT case_id, 'case without question' FROM g WHERE mute UNION ALL SELECT case_id, 'duplicate case id' FROM g WHERE n > 1 AND case_id <> ''""")
def eval_dataset_problems(spark, sf_dir):
    """First turns as a set of questions."""
    turns = tables.table(spark, sf_dir, "conversations").where("turn = 0")
    cases = turns.selectExpr("CASE WHEN conv_id % 50 = 0 THEN ' ' ELSE 'q' || conv_id div 2 END AS case_id", "CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE text END AS question")
    return evaluation.dataset_problems(cases)


@query("SELECT event_type AS node, count(*) AS activations, count(*) FILTER (value > 50) AS fallbacks FROM events GROUP BY event_type")
def trace_activation_counts(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("activations"), F.count_if(F.col("value") > 50).alias("fallbacks"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, round(coalesce(avg(CASE WHEN value > 10 THEN value END), 0), 4) AS mean_above FROM events GROUP BY event_type")
def p95_latency(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.round(F.coalesce(F.avg(F.when(F.col("value") > 10, F.col("value"))), F.lit(0.0)), 4).alias("mean_above"))


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AND o_custkey % 3 <> 0 AS acl_allowed, coalesce(c_nationkey = o_custkey % 25, FALSE) AS is_active, coalesce(c_mktsegment, 'unknown') AS status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def governance_annotation(spark, sf_dir):
    """References with what their generation says of them: allowed, active, status."""
    known = tables.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    both = tables.table(spark, sf_dir, "orders").join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("o_orderkey", (F.col("c_custkey").isNotNull() & (F.col("o_custkey") % 3 != 0)).alias("acl_allowed"), F.coalesce(F.col("c_nationkey") == F.col("o_custkey") % 25, F.lit(False)).alias("is_active"), F.coalesce("c_mktsegment", F.lit("unknown")).alias("status"))


@query("SELECT source || '.txt' AS category, min(doc_id) AS doc_id FROM documents GROUP BY source ORDER BY category LIMIT 14")
def first_sample_per_category(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select(F.col("source_file").alias("category"), "doc_id")
    return corpus.first_of(docs, ["category"], ["doc_id"]).orderBy("category").limit(14)


@query(f"WITH {_SCORED} SELECT case_id, array_to_string(list_sort(list_distinct(wanted)), ',') AS expected FROM want")
def expected_reference_ids(spark, sf_dir):
    told = _told(spark, sf_dir)
    wanted = evaluation.expected_ids(F.col("expected_chunks"), F.col("expected_documents"), F.col("expected_sources"))
    return told.select("case_id", F.array_join(F.array_sort(wanted), ",").alias("expected"))


@query(f"WITH {_SCORED} SELECT case_id, rank, array_to_string(list_sort(ids), ',') AS ids FROM met WHERE there")
def cited_reference_ids(spark, sf_dir):
    """Every reference by the names that it goes by."""
    ids = evaluation.reference_ids(*[F.col(c) for c in ("chunk_id", "matched_chunk_id", "document_id", "source_file")])
    return _references(spark, sf_dir).select("case_id", "rank", F.array_join(F.array_sort(ids), ",").alias("ids"))


@query(f"WITH {_SCORED} SELECT case_id, acl_leaks FROM scored")
def acl_leak_flags(spark, sf_dir):
    return _cases(spark, sf_dir).select("case_id", "acl_leaks")


@query(f"WITH {_SCORED} SELECT case_id, invalid_leaks FROM scored")
def inactive_flags(spark, sf_dir):
    return _cases(spark, sf_dir).select("case_id", "invalid_leaks")


@query(f"""WITH {_SUMMED}, best AS ({_TOP}) SELECT prof.profile, CASE WHEN best.profile IS NOT NULL THEN 'best' WHEN round_even(prof.success_rate - base.success_rate, 4) > 0 OR round_even(prof.avg_reference_score - base.avg_reference_score, 4) >= 0.05 THEN 'apply'
  WHEN round_even(prof.success_rate - base.success_rate, 4) < 0 OR round_even(prof.fallback_rate - base.fallback_rate, 4) > 0.1 THEN 'risk' ELSE 'neutral' END AS advice FROM prof CROSS JOIN base LEFT JOIN best ON best.profile = prof.profile""")
def recommendation_ladder(spark, sf_dir):
    return evaluation.advice(_profiles(spark, sf_dir), "profile")


@query("SELECT generation, fingerprint, max(approved_at) AS approved_at FROM (SELECT o_custkey AS generation, o_orderpriority AS fingerprint, o_orderdate AS approved_at FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY ALL")
def approval_upsert(spark, sf_dir):
    """Approvals by (generation, fingerprint): those of the last run replace the ones before."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("generation"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderdate").alias("approved_at"), "o_orderstatus")
    old, new = orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), orders.where("o_orderstatus = 'O'").drop("o_orderstatus")
    return governance.upsert(old, new, ["generation", "fingerprint"], "approved_at")


RULES = [(("compare", "versus", "than "), "compare"), (("who", "whom"), "person"), (("when", "until"), "time"), (("the", "and"), "lookup"), (("que", "eau"), "foreign")]
TOOLS = [(("compare", "versus"), "hybrid"), (("who", "eau"), "graph")]
_CASE = lambda rules, default: "CASE " + " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(text, '{w}')" for w in words), value) for words, value in rules) + f" ELSE '{default}' END"


@query(f"SELECT conv_id, turn, {_CASE(RULES, 'general')} AS intent FROM conversations")
def intent_ladder(spark, sf_dir):
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.ladder(F.col("text"), RULES, "general").alias("intent"))


@query(f"SELECT conv_id, turn, {_CASE(TOOLS, 'vector')} AS tool FROM conversations")
def tool_ladder(spark, sf_dir):
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.ladder(F.col("text"), TOOLS, "vector").alias("tool"))


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_ROUTE = LATIN_ROUTING
_CATEGORIES = ["lookup", "price list", "person", "change"]
_READ = f"""turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
read AS (SELECT *, CASE WHEN before IS NOT NULL AND {_ANY('text', _ROUTE.follow_up)} THEN before || ' ' || text ELSE text END AS seen FROM turns),
rule AS (SELECT *, CASE {' '.join(f"WHEN {_ANY('seen', words)} THEN {i}" for i, (_, _, _, words, _) in enumerate(_ROUTE.rules))} ELSE 3 END AS r FROM read),
routed AS (SELECT *, ['change', 'price list', 'person', 'lookup'][r + 1] AS intent, ['reasoning', 'tariff', 'single rule', 'single rule'][r + 1] AS kind, CASE WHEN r = 0 THEN 'hybrid' ELSE 'vector' END AS mode, CASE WHEN r = 0 THEN 'audit' ELSE '' END AS more FROM rule)"""


@query(f"WITH {_READ} SELECT conv_id, turn, intent, kind, mode, array_to_string(list_filter([{', '.join('CASE WHEN ' + _ANY('lower(seen)', terms) + f' THEN ' + repr(name) + ' END' for name, terms in LATIN.entities.items())}, nullif(more, '')], lambda x: x IS NOT NULL), ',') AS entities FROM routed")
def question_classes(spark, sf_dir):
    """Turns by the first rule that holds, read with the turn before where they refer to it."""
    found = _routed(spark, sf_dir)
    return found.select("conv_id", "turn", "c.intent", "c.kind", "c.mode", F.array_join("c.entities", ",").alias("entities"))


def _routed(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = tables.table(spark, sf_dir, "conversations").withColumn("before", before)
    return turns.withColumn("c", evaluation.classify(F.col("text"), F.col("before"), _ROUTE, _CATEGORIES, LATIN.entities))


@query(f"WITH {_READ} SELECT conv_id, turn, CASE WHEN intent NOT IN ('change', 'person') AND kind IN ('single rule', 'tariff') THEN 'vector' WHEN {_ANY('text', _ROUTE.hybrid_words)} THEN 'hybrid' WHEN kind IN ('single rule', 'tariff') THEN 'vector' ELSE 'graph' END AS tool FROM routed")
def question_tools(spark, sf_dir):
    c = _routed(spark, sf_dir)
    return c.select("conv_id", "turn", evaluation.choose_tool(F.col("text"), F.col("c.intent"), F.col("c.kind"), _ROUTE).alias("tool"))


_W = {"keywords": ("the", "and", "que", "eau", "ung"), "categories": ("license", "plain"), "entities": ("token", "mit"), "files": ("src0", "src3"), "terms": ("es", "en")}
_K = {k: "(" + " + ".join(f"contains(text, '{w}')::INT" for w in words) + ")" for k, words in _W.items()}


@query(f"SELECT doc_id, round(score, 6)::DOUBLE AS score, score >= 0.3 AS in_scope FROM (SELECT doc_id, least(0.55, 0.12 * {_K['keywords']}) + least(0.25, 0.12 * {_K['categories']}) + least(0.35, 0.2 * {_K['files']} + 0.15 * {_K['terms']}) + least(0.25, 0.1 * {_K['entities']}) AS score FROM documents)")
def scope_score(spark, sf_dir):
    scored = tables.documents(spark, sf_dir).select("doc_id", F.round(evaluation.scope_score(F.col("content"), **_W), 6).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.3).alias("in_scope"))


CATEGORIES = ["ECONOMY", "STANDARD", "PROMO", "SMALL"]


@query("SELECT p_partkey, " + "CASE " + " ".join(f"WHEN contains(p_type, '{c}') OR contains('{c}', p_type) THEN '{c}'" for c in CATEGORIES) + " ELSE '' END AS category FROM part")
def closest_category(spark, sf_dir):
    """The first category that contains the value or is contained in it."""
    kind = F.col("p_type")
    found = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.contains(kind, c) | F.contains(c, kind))
    return tables.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("category"))
