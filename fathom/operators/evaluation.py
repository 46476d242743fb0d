"""Evaluation of retrieval: cases judged by their references, metrics of profiles, deltas, best profile, release
gate and diagnostics; routing ladders.

Cases have: expected_chunks, expected_documents, expected_sources, expected_modes, forbidden_documents (arrays; null is
empty), allowed_documents (null: no rule), expect_references, expect_paths (null: true, false), expected_intent, intent,
retrieval_mode, relation_paths (a count), answer, error, latency_ms, model_calls, trace (array of node, enabled,
fallback). References have: rank (from 0), chunk_id, matched_chunk_id, document_id, source_file, score, relevant,
acl_allowed, is_active (null: not said) and status. Both have the columns that name a case."""

from __future__ import annotations

from fathom.functions.text import matched_terms
from fathom.operators.corpus import entity_matches, keyword_count
from fathom.params import Routing
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of a profile's quality score, statuses of content that is not in force, and nodes of a
# trace that count as active wherever they occur.
WEIGHTS = {"success_rate": 0.30, "fallback_correct_rate": 0.15, "source_hit_rate": 0.15, "graph_path_coverage": 0.15, "retrieval_mode_match_rate": 0.10, "avg_reference_score": 0.10, "intent_match_rate": 0.05}
INACTIVE = ("deleted", "inactive", "retired", "tombstoned")
ALWAYS_ACTIVE = ("agent_tool_choice", "retrieve", "generate_answer", "business_scope_check")
EPSILON = 1e-12
#: What deltas are given of, in this order.
DELTAS = ("success_rate", "fallback_rate", "avg_latency_ms", "avg_reference_score", "source_hit_rate", "graph_path_coverage")


def ratio(a: Column, b: Column) -> Column:
    """a / b with four places, 0 where b is 0."""
    return F.coalesce(F.bround(F.try_divide(a, b), 4), F.lit(0.0))


def average(c: Column) -> Column:
    """Mean of what isn't null with four places, 0 without any."""
    return F.coalesce(F.bround(F.avg(c), 4), F.lit(0.0))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _tagged(kind: str, values: Column) -> Column:
    said = F.filter(values, lambda v: F.trim(v) != "")
    return F.transform(said, lambda v: F.concat(F.lit(f"{kind}:"), F.trim(v)))


def expected_ids(chunks: Column, documents: Column, sources: Column) -> Column:
    """What a case expects, once each: its chunks if it lists any, else documents, else source files."""
    pick = F.when(F.size(chunks) > 0, _tagged("chunk", chunks)).when(F.size(documents) > 0, _tagged("document", documents)).otherwise(_tagged("source", sources))
    return F.array_distinct(_filled(pick))


def reference_ids(chunk: Column, matched: Column, document: Column, source: Column) -> Column:
    """The names that a reference goes by; the child that matched counts as a chunk."""
    named = F.concat(_tagged("chunk", F.array(chunk, matched)), _tagged("document", F.array(document)), _tagged("source", F.array(source)))
    return F.array_distinct(named)


def acl_leak(decision: Column, document: Column, allowed: Column) -> Column:
    """A decision counts alone where there is one; without one a document outside the list leaks, if a list is there."""
    listed = F.coalesce(F.array_contains(allowed, F.trim(document)), F.lit(False))
    return F.when(decision.isNotNull(), ~decision).otherwise(allowed.isNotNull() & ~listed)


def invalid_content(active: Column, status: Column, document: Column, forbidden: Column) -> Column:
    """Said to be inactive, of a status not in force, or a forbidden document."""
    return ~F.coalesce(active, F.lit(True)) | F.coalesce(F.lower(status).isin(*INACTIVE), F.lit(False)) | F.coalesce(F.array_contains(forbidden, document), F.lit(False))


def names_meet(source: Column, expected: Column) -> Column:
    """Whether a name contains one of the expected ones or is contained in one."""
    meets = lambda e: (e != "") & (F.contains(source, e) | F.contains(e, source))
    return F.coalesce((source != "") & F.exists(expected, meets), F.lit(False))


def score_cases(cases: DataFrame, references: DataFrame, scope: list[str], no_match: list[str]) -> DataFrame:
    """One row a case with its flags, recall (null where nothing is expected) and counts of its citations.

    ``no_match``: answers that say that nothing was found. Both tables are shuffled by case once; a case keeps
    counts and at most the expected names that its first five references have."""
    told = cases.select(
        *scope,
        F.struct(*[c for c in cases.columns if c not in scope]).alias("case"),
        expected_ids(F.col("expected_chunks"), F.col("expected_documents"), F.col("expected_sources")).alias("wanted"),
    )
    ids = reference_ids(F.col("chunk_id"), F.col("matched_chunk_id"), F.col("document_id"), F.col("source_file"))
    cited = references.withColumns({"ids": ids, "cited": F.lit(1)})
    both = told.join(cited, scope, "left").withColumn("hit", F.coalesce("relevant", F.arrays_overlap("wanted", "ids"), F.lit(False)))
    there = F.col("cited").isNotNull()
    leaks = acl_leak(F.col("acl_allowed"), F.col("document_id"), F.col("case.allowed_documents"))
    invalid = invalid_content(F.col("is_active"), F.col("status"), F.col("document_id"), F.col("case.forbidden_documents"))
    rows = both.groupBy(*scope).agg(
        F.any_value("case").alias("case"),
        F.any_value("wanted").alias("wanted"),
        F.count("cited").alias("reference_count"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("rank") < 5, F.array_intersect("wanted", "ids"))))).alias("recalled"),
        F.min(F.when(F.col("hit") & (F.col("rank") < 10), F.col("rank"))).alias("first"),
        F.count_if(there & F.col("hit")).alias("relevant_count"),
        F.count_if(there & leaks).alias("acl_leaks"),
        F.count_if(there & invalid).alias("invalid_leaks"),
        F.count_distinct(F.nullif("source_file", F.lit(""))).alias("source_count"),
        average(F.when(there, F.coalesce("score", F.lit(0.0)))).alias("avg_reference_score"),
        F.coalesce(F.bool_or(names_meet(F.col("source_file"), F.col("case.expected_sources"))), F.lit(False)).alias("source_met"),
    )
    case = lambda c: F.col(f"case.{c}")
    text = lambda c: F.coalesce(case(c), F.lit(""))
    wants, paths = F.coalesce(case("expect_references"), F.lit(True)), F.coalesce(case("expect_paths"), F.lit(False))
    cites, answer, wanted = F.col("reference_count") > 0, text("answer"), F.size("wanted") > 0
    nothing = F.lit(False)
    for said in no_match:
        nothing = nothing | F.contains(answer, F.lit(said))
    fallback = nothing | ~cites
    correct = F.when(wants, ~fallback).otherwise(nothing & ~cites)
    modes = _filled(case("expected_modes"))
    rewritten = F.exists(case("trace"), lambda t: (t["node"] == "context_rewrite") & t["enabled"] & ~F.coalesce(t["fallback"], F.lit(False)))
    return rows.select(
        *scope,
        F.when(wants, text("error").eqNullSafe("") & cites & ~fallback).otherwise(correct).alias("success"),
        cites.alias("has_references"),
        "reference_count",
        "avg_reference_score",
        "source_count",
        F.greatest(F.lit(0), F.coalesce(case("latency_ms"), F.lit(0))).cast("long").alias("latency_ms"),
        fallback.alias("fallback"),
        F.length(answer).cast("long").alias("answer_length"),
        ((text("expected_intent") == "") | (text("intent") == text("expected_intent"))).alias("intent_match"),
        ((F.size(modes) == 0) | F.coalesce(F.array_contains(modes, case("retrieval_mode")), F.lit(False))).alias("retrieval_mode_match"),
        ((F.size(_filled(case("expected_sources"))) == 0) | F.col("source_met")).alias("source_hit"),
        (~paths | (F.coalesce(case("relation_paths"), F.lit(0)) > 0)).alias("graph_path_hit"),
        F.coalesce(rewritten, F.lit(False)).alias("context_rewrite_triggered"),
        correct.alias("fallback_correct"),
        (text("error") != "").alias("failed"),
        F.when(wanted, F.size("recalled") / F.size("wanted")).alias("recall"),
        F.when(wanted, F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))).alias("reciprocal_rank"),
        wants.alias("expects"),
        (wants & (F.col("relevant_count") > 0)).alias("covered"),
        (wants & (F.trim(answer) != "") & ~cites).alias("unfounded"),
        "relevant_count",
        "acl_leaks",
        "invalid_leaks",
        F.greatest(F.lit(0), F.coalesce(case("model_calls"), F.lit(0))).cast("long").alias("model_calls"),
    )


def quality_metrics(scored: DataFrame, scope: list[str]) -> DataFrame:
    """The nine measures of retrieval over scored cases; p95 is the nearest rank."""
    return scored.groupBy(*scope).agg(*_quality())


def _quality() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cited = total("reference_count")
    return [
        average(F.col("recall")).alias("recall_at_5"),
        average(F.col("reciprocal_rank")).alias("mrr_at_10"),
        ratio(total("relevant_count"), cited).alias("citation_precision"),
        ratio(F.count_if("covered"), F.count_if("expects")).alias("citation_coverage"),
        ratio(F.count_if("unfounded"), F.count_if("expects")).alias("no_evidence_answer_rate"),
        ratio(total("acl_leaks"), cited).alias("acl_leakage_rate"),
        ratio(total("invalid_leaks"), cited).alias("invalid_content_leakage_rate"),
        F.coalesce(F.expr("percentile_disc(0.95) within group (order by latency_ms)"), F.lit(0)).cast("long").alias("p95_latency_ms"),
        total("model_calls").alias("model_call_count"),
    ]


def profile_summary(scored: DataFrame, scope: list[str]) -> DataFrame:
    """Rates and means of the cases of each profile, its nine measures and its quality score."""
    rate = lambda c: ratio(F.count_if(c), F.count("*"))
    whole = lambda c: F.floor(F.avg(c)).cast("long")
    summary = scored.groupBy(*scope).agg(
        F.count("*").alias("question_count"),
        rate("success").alias("success_rate"),
        rate("fallback").alias("fallback_rate"),
        rate("failed").alias("error_rate"),
        whole("latency_ms").alias("avg_latency_ms"),
        average(F.col("reference_count")).alias("avg_reference_count"),
        average(F.when(F.col("avg_reference_score") > 0, F.col("avg_reference_score"))).alias("avg_reference_score"),
        whole("answer_length").alias("avg_answer_length"),
        rate("intent_match").alias("intent_match_rate"),
        rate("retrieval_mode_match").alias("retrieval_mode_match_rate"),
        rate("source_hit").alias("source_hit_rate"),
        rate("graph_path_hit").alias("graph_path_coverage"),
        rate("fallback_correct").alias("fallback_correct_rate"),
        *_quality(),
    )
    return summary.withColumn("quality_score", quality_score())


def quality_score() -> Column:
    """Weighted sum of a profile's rates, each held within 0 and 1."""
    return F.bround(sum(w * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c, w in WEIGHTS.items()), 4)


def trace_counts(cases: DataFrame, scope: list[str]) -> DataFrame:
    """node, activations and fallbacks over the traces of cases; nodes that do neither are left out."""
    steps = cases.select(*scope, F.explode("trace").alias("t")).select(*scope, "t.node", "t.enabled", "t.fallback")
    active = F.coalesce("enabled", F.lit(False)) | F.col("node").isin(*ALWAYS_ACTIVE)
    found = steps.groupBy(*scope, "node").agg(F.count_if(active).alias("activations"), F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallbacks"))
    return found.where("activations > 0 or fallbacks > 0")


def with_baseline(profiles: DataFrame, order: str) -> DataFrame:
    """Summaries with a struct ``base``: the first of them by ``order``. Profiles are settings, a handful of rows
    however many cases they have, so one task has them all."""
    first = F.first(F.struct(*[c for c in profiles.columns if c != order])).over(Window.orderBy(order))
    return profiles.withColumn("base", first).withColumn("is_base", F.row_number().over(Window.orderBy(order)) == 1)


def deltas(profiles: DataFrame, order: str) -> DataFrame:
    """What each profile has more than the first one."""
    more = lambda c: F.col(c) - F.col(f"base.{c}")
    return with_baseline(profiles, order).select(order, *[(more(c) if c == "avg_latency_ms" else F.bround(more(c), 4)).alias(f"{c}_delta") for c in DELTAS])


def best_profile(profiles: DataFrame, order: str) -> DataFrame:
    """The profile with the best score; of equals that with more success, right fallbacks, source hits, paths,
    reference score, then less latency, then the first."""
    keys = ("quality_score", "success_rate", "fallback_correct_rate", "source_hit_rate", "graph_path_coverage", "avg_reference_score")
    return profiles.orderBy(*[F.desc(k) for k in keys], "avg_latency_ms", order).limit(1)


def improved() -> Column:
    """Better citations than the baseline (``base``); where its citations can't be better, better recall or rank."""
    more = lambda c: F.col(c) > F.col(f"base.{c}") + EPSILON
    cited = more("citation_precision") | more("citation_coverage") | (F.col("no_evidence_answer_rate") + EPSILON < F.col("base.no_evidence_answer_rate"))
    full = (F.col("base.citation_precision") >= 1 - EPSILON) & (F.col("base.citation_coverage") >= 1 - EPSILON) & (F.col("base.no_evidence_answer_rate") <= EPSILON)
    return cited | (full & (more("recall_at_5") | more("mrr_at_10")))


def gate(profiles: DataFrame, order: str, eligible: bool = True) -> DataFrame:
    """Eight checks of each profile against the first; all must hold. reasons: names of those that don't. The
    first has no verdict (null); nothing passes on questions that aren't fixed (``eligible``)."""
    value, base = F.col, lambda c: F.col(f"base.{c}")
    checks = {
        "acl_leakage_zero": value("acl_leakage_rate") == 0,
        "invalid_content_leakage_zero": value("invalid_content_leakage_rate") == 0,
        "recall_regression_within_limit": value("recall_at_5") + EPSILON >= base("recall_at_5") - 0.02,
        "p95_latency_within_limit": value("p95_latency_ms") <= base("p95_latency_ms") * 1.2 + EPSILON,
        "citation_precision_non_regression": value("citation_precision") + EPSILON >= base("citation_precision"),
        "citation_coverage_non_regression": value("citation_coverage") + EPSILON >= base("citation_coverage"),
        "no_evidence_answer_non_regression": value("no_evidence_answer_rate") <= base("no_evidence_answer_rate") + EPSILON,
        "primary_quality_improved": improved(),
    }
    failing = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    if not eligible:
        failing = F.array(F.lit("fixed_dataset_required"))
    reasons = F.when(F.col("is_base"), F.array(F.lit("baseline_reference"))).otherwise(failing)
    judged = with_baseline(profiles, order).select(order, "is_base", reasons.alias("reasons"))
    return judged.select(order, "reasons", F.when(~F.col("is_base"), F.size("reasons") == 0).alias("passed"))


def recommendation(success_delta: Column, score_delta: Column, fallback_delta: Column) -> Column:
    return F.when((success_delta > 0) | (score_delta >= 0.05), "apply").when((success_delta < 0) | (fallback_delta > 0.1), "risk").otherwise("neutral")


def advice(profiles: DataFrame, order: str) -> DataFrame:
    """best for the best profile, else what the deltas say."""
    top = best_profile(profiles, order).select(order, F.lit("best").alias("_top"))
    said = recommendation(F.col("success_rate_delta"), F.col("avg_reference_score_delta"), F.col("fallback_rate_delta"))
    return deltas(profiles, order).join(F.broadcast(top), order, "left").select(order, F.coalesce("_top", said).alias("advice"))


def diagnostics(scored: DataFrame, best: DataFrame, profile: str) -> DataFrame:
    """Cases of the best profile by what failed: intent_mismatch, fallback_failure, graph_path_miss."""
    kinds = {"intent_mismatch": "intent_match", "fallback_failure": "fallback_correct", "graph_path_miss": "graph_path_hit"}
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(kind)) for kind, c in kinds.items()]))
    return scored.join(F.broadcast(best.select(profile)), profile, "left_semi").withColumn("failure", F.explode(failed))


def dataset_problems(cases: DataFrame, about: dict | None = None, schema_version: int = 1) -> DataFrame:
    """case_id and problem of rows that no fixed set of questions may have: a blank id or question, an id again. With
    ``about`` (schema_version, dataset_id, dataset_version) what is wrong with the set itself, too, under a null id: another
    schema, no name or version, no cases at all. An empty result says that the set can be trusted."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rows = cases.groupBy(F.trim("case_id").alias("case_id")).agg(F.count("*").alias("n"), F.bool_or(blank(F.col("question"))).alias("mute"))
    said = F.array(F.when(blank(F.col("case_id")), "case without id"), F.when(F.col("mute"), "case without question"), F.when((F.col("n") > 1) & ~blank(F.col("case_id")), "duplicate case id"))
    found = rows.select("case_id", F.explode(F.array_compact(said)).alias("problem"))
    if about is None:
        return found
    version, name = about.get("schema_version"), lambda key: isinstance(about.get(key), str) and about[key].strip()
    wrong = [] if version == schema_version and not isinstance(version, bool) else [f"unsupported schema version: {version!r}"]
    wrong += [f"no {key}" for key in ("dataset_id", "dataset_version") if not name(key)]
    whole = F.array_compact(F.array(*[F.lit(x) for x in wrong], F.when(F.count("*") == 0, "no cases")))
    return found.unionByName(cases.agg(whole.alias("w")).select(F.lit(None).cast("string").alias("case_id"), F.explode("w").alias("problem")))


def model_calls(calls: DataFrame, scope: list[str]) -> DataFrame:
    """Counters of calls (scope, kind: chat, embedding or rerank, inputs): of each kind its calls, of the last two their
    inputs (none below 0), and all calls; kinds that aren't known count in nothing."""
    of = lambda kind: F.col("kind") == kind
    inputs = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.greatest(F.lit(0), F.coalesce("inputs", F.lit(0))))), F.lit(0)).cast("long").alias(f"{kind}_inputs")
    return calls.groupBy(*scope).agg(
        F.count_if(F.col("kind").isin("chat", "embedding", "rerank")).alias("total_calls"),
        F.count_if(of("chat")).alias("chat_calls"),
        F.count_if(of("embedding")).alias("embedding_calls"),
        inputs("embedding"),
        F.count_if(of("rerank")).alias("rerank_calls"),
        inputs("rerank"),
    )


def judged_references(references: DataFrame, documents: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """References with acl_allowed, is_active and status as the index has them (documents: document_id, status): allowed
    where the reader's list (``allowed``: document_id) has the document, or where there is no list (null); active where the
    index has it and it isn't out of force. Both are joined by document, each of which is one row."""
    known = documents.groupBy("document_id").agg(F.max("status").alias("_status"), F.lit(True).alias("_known"))
    rows = references.drop("acl_allowed", "is_active", "status").join(known, "document_id", "left")
    if allowed is not None:
        rows = rows.join(allowed.select("document_id").distinct().withColumn("_allowed", F.lit(True)), "document_id", "left")
    listed = F.coalesce(F.col("_allowed"), F.lit(False)) if allowed is not None else F.lit(None).cast("boolean")
    active = F.coalesce(F.col("_known"), F.lit(False)) & ~F.coalesce(F.lower("_status").isin(*INACTIVE), F.lit(False))
    return rows.withColumns({"acl_allowed": listed, "is_active": active, "status": F.coalesce("_status", F.lit(""))}).drop("_status", "_known", "_allowed")


def ladder(text: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """The first rule with a word that the text contains."""
    out = F
    for words, value in rules:
        out = out.when(keyword_count(text, words) > 0, value)
    return out.otherwise(default)


def _closest(intent: str, categories: list[str]) -> str:
    """The intent if it is a category; else the first that contains it or is contained in it; else the first."""
    if intent in categories:
        return intent
    near = [c for c in categories if intent in c or c in intent]
    return (near or categories or [""])[0]


def classify(question: Column, previous: Column, routing: Routing, categories: list[str], entities: dict[str, tuple[str, ...]]) -> Column:
    """intent, kind, mode and entities of a question by the first rule that holds. A question that refers to what was
    said is read together with the turn before (null: there is none)."""
    refers = (keyword_count(question, routing.follow_up) > 0) & previous.isNotNull()
    read = F.when(refers, F.concat_ws(" ", previous, question)).otherwise(question)
    named = entity_matches(read, entities)
    made = lambda intent, kind, mode, more: F.struct(F.lit(intent).alias("intent"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.concat(named, F.array(*map(F.lit, more)).cast("array<string>")).alias("entities"))
    out = F
    for intent, kind, mode, words, more in routing.rules:
        out = out.when(keyword_count(read, words) > 0, made(_closest(intent, categories), kind, mode, more))
    default = routing.default_intent if routing.default_intent in categories else (categories or [""])[0]
    return out.otherwise(made(default, routing.default_kind, "vector", ()))


def choose_tool(question: Column, intent: Column, kind: Column, routing: Routing) -> Column:
    """vector for simple kinds outside the core, hybrid where a word asks for relations and text, else by kind."""
    simple = kind.isin(*routing.simple_kinds)
    return F.when(~intent.isin(*routing.core_intents) & simple, "vector").when(keyword_count(question, routing.hybrid_words) > 0, "hybrid").when(simple, "vector").otherwise("graph")


def scope_score(text: Column, keywords: tuple[str, ...], categories: tuple[str, ...], entities: tuple[str, ...], files: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    """0.12 a keyword up to 0.55, 0.12 a category up to 0.25, 0.2 a file and 0.15 a term up to 0.35, 0.1 an
    entity up to 0.25."""
    n = lambda words: keyword_count(text, words)
    most = lambda limit, c: F.least(F.lit(limit), c)
    return most(0.55, 0.12 * n(keywords)) + most(0.25, 0.12 * n(categories)) + most(0.35, 0.2 * n(files) + 0.15 * n(terms)) + most(0.25, 0.1 * n(entities))


def scope_verdict(text: Column, excluded: tuple[str, ...], keywords: tuple[str, ...], categories: tuple[str, ...], entities: Column, files: Column, terms: Column, least: float) -> Column:
    """in_scope, score, excluded (what of these the text says): the score of ``scope_score`` with the files, terms and
    entities found elsewhere (arrays), 1 at most, with four places; a text that says an excluded word is out of scope."""
    most = lambda limit, c: F.least(F.lit(limit), c)
    n = lambda words: keyword_count(text, tuple(dict.fromkeys(w.strip() for w in words if w.strip())))
    size = lambda c: F.greatest(F.lit(0), F.size(c))
    points = most(0.55, 0.12 * n(keywords)) + most(0.25, 0.12 * n(categories)) + most(0.35, 0.2 * size(files) + 0.15 * size(terms)) + most(0.25, 0.1 * size(entities))
    score = F.bround(most(1.0, points), 4)
    said = matched_terms(F.coalesce(text, F.lit("")), excluded)
    return F.struct(((F.size(said) == 0) & (score >= least)).alias("in_scope"), score.alias("score"), said.alias("excluded"))
