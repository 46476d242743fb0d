"""Tables of questions against the searches and tools for one question, and those against loops."""

import random

import numpy as np
import pytest
from fathom.operators import batch, evidence, retrieval
from fathom.operators.terms import contains_any, knowledge_terms, shards, term_hits
from fathom.params import LATIN, RetrievalSettings, evaluation_profiles
from pyspark.sql import functions as F
from test_evidence import _loop

UNIT = "chunk_id string, document_id string, parent_chunk_id string, granularity string, source_file string, content string, category string, embedding array<double>"
WORDS = ["fox", "river", "licence", "the", "and", "token", "aa", "aaa", "été", "日本"]


@pytest.fixture(scope="module")
def tables(spark):
    rng, np_rng = random.Random(5), np.random.default_rng(5)
    vectors = [np_rng.standard_normal(6).tolist() for _ in range(25)]
    rows = []
    for i in range(140):
        v = rng.choice(vectors) if i % 3 else np_rng.standard_normal(6).tolist()  # copies tie
        v = {7: None, 8: [0.0] * 6, 9: [1.0] * 4, 10: [float("nan")] * 6}.get(i, v)
        text = None if i == 11 else "" if i == 12 else " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))
        rows.append((f"u{i:03}", f"d{i % 6}", f"p{i % 9}" if i % 4 else None, ["paragraph", "sentence", "document"][i % 3], f"f{i % 5}", text, f"c{i % 4}" if i != 13 else None, v))
    units = spark.createDataFrame(rows, UNIT).repartition(5)
    known = {(f"d{i}", f"p{j}"): f"parent {i} {j} " + rng.choice(WORDS) * 3 for i in range(6) for j in range(6)}
    parents = spark.createDataFrame([(p, d, "document", "pf", t) for (d, p), t in known.items()], "chunk_id string, document_id string, granularity string, source_file string, content string")
    asked = []
    for q in range(9):
        words = rng.sample(WORDS, rng.randint(1, 4)) if q else []
        question = " ".join(words) + (", and compare, explain, list; must " * 2 if q % 4 == 0 else "")
        asked.append((q, question, None if q == 5 else np_rng.standard_normal(6).tolist() if q % 2 else rng.choice(vectors), f"c{q % 5}", words[:2], words + ["", words[0] if words else ""], [f"f{q % 7}", "f1"], "hybrid" if q % 3 else "vector"))
    questions = spark.createDataFrame(asked, "question_id long, question string, query array<double>, category string, entities array<string>, terms array<string>, files array<string>, mode string")
    return units, parents, questions, asked, known


def _rows(df, *columns):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()]


def _one(spark, question, units, k, candidates, min_score):
    query = spark.createDataFrame([(question[2] or [0.0] * 6,)], "query array<double>")
    found = retrieval.vector_search(units.where("chunk_id <> 'u010'").fillna("", ["content"]), query, question[3], question[4], question[6], k, candidates, min_score, "chunk_id")
    return evidence.placed(found, F.desc("score"), F.desc("vector_score"), "chunk_id")


@pytest.mark.parametrize("block_bytes", [32 << 20, 200])
def test_vector_batch_equals_single_searches(spark, tables, block_bytes):
    units, _, questions, asked, _ = tables
    plain = units.where("chunk_id <> 'u010'")
    settings = batch.question_settings({"a": RetrievalSettings(top_k=3, candidate_k=15, min_score=0.1), "b": RetrievalSettings(top_k=2, candidate_k=5, min_score=0.4)}, questions, LATIN)
    found = batch.vector_batch(plain, questions, settings)
    assert batch.nearest(plain, questions, 4, block_bytes=block_bytes).where("pos <= 4").count() == 4 * len(asked)
    got = {}
    for p, q, *hit in _rows(found, "profile", "question_id", "pos", "chunk_id", "score", "vector_score"):
        got.setdefault((p, q), []).append(tuple(hit))
    for name, k, least in (("a", 15, 0.1), ("b", 8, 0.4)):
        for question in asked:
            wanted = _rows(_one(spark, question, units, k, k, least), "pos", "chunk_id", "score", "vector_score")
            assert sorted(got.get((name, question[0]), [])) == sorted(wanted), (name, question[0])


@pytest.mark.parametrize("k,block_bytes", [(4, 64 << 20), (200, 64 << 20), (6, 300)])
def test_term_batches_equal_single_searches(spark, tables, k, block_bytes):
    units, _, questions, asked, _ = tables
    words, terms = batch.keyword_batch(units, questions, k, block_bytes=block_bytes), batch.term_batch(units, questions, k, block_bytes=block_bytes)
    for found, one in ((words, "words"), (terms, "terms")):
        got = {}
        for q, pos, chunk, score in _rows(found, "question_id", "pos", "chunk_id", "score"):
            got.setdefault(q, []).append((pos, chunk, score))
        for question in asked:
            said = sorted({t for t in question[5] if t})
            filled = units.fillna("", ["content", "category"])
            single = retrieval.keyword_category_search(filled, question[3], said, question[6], k, "chunk_id") if one == "words" else retrieval.term_frequency_search(filled, said, k, "chunk_id")
            wanted = _rows(evidence.placed(single, F.desc(F.round("score", 9)), "chunk_id"), "pos", "chunk_id", "score")
            assert sorted(got.get(question[0], [])) == sorted(wanted), (one, question[0])


def test_tools_of_all_profiles_equal_single_tools(spark, tables):
    units, parents, questions, asked, _ = tables
    units = units.where("chunk_id <> 'u010'").fillna("", ["content", "category"])
    profiles = evaluation_profiles(RetrievalSettings(top_k=3, candidate_k=8, min_score=0.2, dedup_threshold=0.6))
    settings = batch.question_settings(profiles, questions, LATIN)
    graph_rows = [(q, pos, f"u{(q * 17 + pos * 5) % 130 + 14:03}", pos / 10) for q in range(9) for pos in range(1, 6)]
    graph = spark.createDataFrame(graph_rows, "question_id long, pos int, chunk_id string, score double").join(units.drop("embedding", "category"), "chunk_id")
    found = batch.tool_batch(units, parents, questions, settings, graph)
    got = {}
    for p, q, *hit in _rows(found, "profile", "question_id", "pos", "chunk_id", "score", "matched_chunk_id"):
        got.setdefault((p, q), []).append(tuple(hit))
    assert {r["profile"] for r in settings.collect()} == set(profiles) and len(profiles) == 12
    for name in ("baseline_new_retrieval", "parent_context_enabled", "dedup_enabled", "all_enhancements"):
        s = profiles[name]
        seen = units if s.multi_vector_enabled else units.where("granularity = 'document'")
        for question in asked[:5]:
            (own,) = settings.where((F.col("profile") == name) & (F.col("question_id") == question[0])).collect()
            k, candidates = own["top_k"], own["candidates"]
            assert candidates == max(4 * k, 8) and (k == 3 or s.dynamic_top_k_enabled)
            vector = _one(spark, question, seen, k, candidates, s.min_score).select("pos", *evidence.HIT)
            if question[7] == "hybrid":
                words = evidence.placed(retrieval.term_frequency_search(seen, sorted({t for t in question[5] if t}), candidates, "chunk_id"), F.desc("score"), "chunk_id").select("pos", *evidence.HIT)
                own_graph = graph.where(F.col("question_id") == question[0]).select("pos", *evidence.HIT)
                streams = [x.where(F.col("pos") <= k) for x in (vector, own_graph)] + [words]
                vector = retrieval.round_robin(streams, candidates, [], "chunk_id").drop("pos", "stream").withColumnRenamed("rank", "pos")
            if s.parent_context_enabled:
                vector = evidence.with_parents(vector, parents)
            else:
                vector = vector.withColumn("matched_chunk_id", F.lit(None).cast("string"))
            if s.dedup_enabled:
                vector = evidence.without_near_copies(vector, 0.6)
            wanted = _rows(vector.where(F.col("pos") <= k), "pos", "chunk_id", "score", "matched_chunk_id")
            assert sorted(got.get((name, question[0]), [])) == sorted(wanted), (name, question[0])


def test_batches_of_nothing(spark, tables):
    units, parents, questions, _, _ = tables
    settings = batch.question_settings({"a": RetrievalSettings()}, questions, LATIN)
    assert batch.nearest(units, questions.limit(0), 3).count() == 0 and batch.nearest(units.limit(0), questions, 3).count() == 0
    assert batch.keyword_batch(units.limit(0), questions, 3).count() == 0 and batch.term_batch(units, questions.limit(0), 3).count() == 0
    assert batch.tool_batch(units.limit(0), parents, questions, settings).count() == 0


def test_candidates_of_several_vectors_equal_a_loop(spark, tables):
    units, _, questions, asked, _ = tables
    units = units.where("chunk_id <> 'u010'").fillna("", ["content", "category"])
    queries = [asked[i][2] for i in (0, 1, 3)]
    frames = [spark.createDataFrame([(q,)], "query array<double>") for q in queries]
    best, first = {}, {}
    for n, q in enumerate(queries):
        scored = []
        for r in units.collect():
            v = r["embedding"]
            size = np.linalg.norm(v) * np.linalg.norm(q) if v and len(v) == len(q) else 0
            cos = max(0.0, float(np.dot(v, q) / size)) if size else 0.0
            scored.append((-round(cos, 12), r["chunk_id"], r))
        scored = sorted(scored, key=lambda x: x[:2])[:12]
        points = []
        for cos, chunk, r in scored:
            s = 0.65 * -cos + 0.2 * (r["category"] == "c1") + 0.1 * sum(e in r["content"] for e in ("fox", "the")) / 2 + 0.05 * (r["source_file"] == "f2")
            if s >= 0.2:
                points.append((-round(s, 12), cos, chunk))
        for i, (s, _, chunk) in enumerate(sorted(points)[:12]):
            first.setdefault(chunk, (n, i))
            best[chunk] = max(best.get(chunk, 0), -s)
    wanted = sorted(((-s, first[c], c) for c, s in best.items()))[:12]
    got = evidence.vector_candidates(units, frames, "c1", ["fox", "the"], ["f2"], 3, 12, 0.2).orderBy("pos").collect()
    assert [(r["chunk_id"], round(r["score"], 9)) for r in got] == [(c, round(-s, 9)) for s, _, c in wanted]


def test_vector_and_graph_tools_equal_a_loop(spark, tables):
    units, parents, _, _, known = tables
    rows = [tuple(r) for r in units.fillna("").where("chunk_id <> 'u010'").select("chunk_id", "document_id", "parent_chunk_id", "granularity", "source_file", "content").orderBy(F.xxhash64("chunk_id")).limit(20).collect()]
    hits = [(i, *r, round(1 - i / 40 + (i % 3) / 20, 3)) for i, r in enumerate(rows, 1)]
    table = spark.createDataFrame(hits, "pos int, chunk_id string, document_id string, parent_chunk_id string, granularity string, source_file string, content string, score double")
    shown = lambda df: [(r["chunk_id"], r["document_id"], r["content"], r["score"], r["matched_chunk_id"]) for r in df.orderBy("pos").collect()]
    assert shown(evidence.vector_tool(table, parents, 6)) == _loop([hits], known, 6, 100)
    paths = spark.createDataFrame([(i, f"a -> b{i}") for i in range(1, 9)], "pos int, path string")
    found = evidence.graph_tool(evidence.Found(table, paths, "graph_vector_mix"), parents, 4)
    assert shown(found.chunks) == _loop([hits[:4]], known, 4, 100) and found.paths.count() == 4 and found.source == "graph_vector_mix"


def test_all_paths_are_kept(spark):
    """A node of any number of edges: all of them have a place, in turn with those of relationships."""
    edges = spark.createDataFrame([("hub", "to", f"n{i:05}", f"by {i}", "", "f", "d", (i * 37 % 1000) / 1000) for i in range(2500)], "source string, label string, target string, description string, evidence string, source_file string, document_id string, confidence double")
    hits = spark.createDataFrame([("hub", 0.3)], "id string, score double")
    said = spark.createDataFrame([("hub", "to", f"n{i:05}", 0.5) for i in range(3)] + [("x", "y", "z", 0.9)], "source string, label string, target string, score double")
    got = evidence.mixed_paths(hits, said, edges).orderBy("pos").collect()
    local = sorted((-max(0.3, (i * 37 % 1000) / 1000), f"hub -> to -> n{i:05}") for i in range(2500))
    other = [(-0.9, "x -> y -> z")] + [(-0.5, f"hub -> to -> n{i:05}") for i in range(3)]
    turns, seen = [], set()
    for i in range(2500):
        for stream in (local, other):
            if i < len(stream) and stream[i][1] not in seen:
                seen.add(stream[i][1])
                turns.append(stream[i][1])
    assert [r["path"] for r in got] == turns and [r["pos"] for r in got] == list(range(1, 2502))


@pytest.mark.parametrize("most_bytes", [256 << 20, 100])
def test_term_hits_equal_counts(spark, most_bytes):
    terms = ["a", "aa", "aaa", "ab", "été", "日本", "x y", "", "zzz", "\n"]
    texts = ["aaaa", "ababab", "été ÉTÉ", "日本日本", "x y x", None, "", "a\nb", "aaaa"]
    rows = spark.createDataFrame([(i % 8, t, "n") for i, t in enumerate(texts)], "id int, text string, term string")
    said = spark.createDataFrame([(t,) for t in [*terms, "a", None]], "t string")
    assert most_bytes > 1000 or len(shards(said, most_bytes)) > 3
    got = sorted(map(tuple, term_hits(rows, ["id"], "text", said, most_bytes=most_bytes).collect()))
    assert got == sorted((i % 8, t, x.count(t)) for i, x in enumerate(texts) if x for t in terms if t and t in x)
    assert term_hits(rows, ["id"], "text", said.limit(0)).count() == 0


def test_knowledge_terms_equal_a_loop(spark):
    base = [("2024 Travel costs.txt", ["fare", "hotel"]), ("“Blue line” rules.md", ["line", ""]), ("x.txt", ["yy"]), ("", ["hotel"])]
    texts = [(1, "the fare of the Blue line"), (2, "x.txt says hotel"), (3, "nothing"), (4, None), (1, "Travel costs")]
    got = knowledge_terms(spark.createDataFrame(texts, "id int, body string"), ["id"], "body", spark.createDataFrame(base, "source_file string, keywords array<string>"))
    assert sorted((r["id"], tuple(r["files"]), tuple(r["terms"])) for r in got.collect()) == [(1, ("2024 Travel costs.txt",), ("Travel costs",)), (1, ("“Blue line” rules.md",), ("Blue line", "fare", "line")), (2, ("x.txt",), ("hotel",)), (3, (), ()), (4, (), ())]
    (r,) = spark.range(1).select(contains_any(F.lit("abc"), ["", "bc"]).alias("a"), contains_any(F.lit("abc"), []).alias("b")).collect()
    assert r["a"] and not r["b"]


@pytest.mark.parametrize("most_bytes", [256 << 20, 400])
def test_knowledge_terms_gather_no_hits(spark, most_bytes):
    base = [("a.txt", ["fare", "hotel", "", None]), ("b.txt", ["hotel", "a.txt"]), ("b.txt", None), ("“Blue line” one.md", []), ("“Blue line” two.md", ["été"]), (None, ["ghost"]), ("", ["日本"])]
    texts = [(1, "fare hotel a.txt"), (1, "fare hotel a.txt"), (1, "Blue line été"), (None, "ghost 日本"), (None, None), (2, ""), (3, "nothing"), (3, "b.txtb.txt"), (4, "hotel hotel")] + [(9, "hotel, Blue line")] * 40
    categories = spark.createDataFrame(base, "source_file string, keywords array<string>")
    assert most_bytes > 1000 or len(shards(categories.select(F.explode("keywords")), most_bytes)) > 1
    got = knowledge_terms(spark.createDataFrame(texts, "id int, body string").repartition(3), ["id"], "body", categories, most_bytes)

    topics = {"a.txt": set(), "b.txt": set(), "“Blue line” one.md": {"Blue line"}, "“Blue line” two.md": {"Blue line"}}
    said = {k for _, ks in base for k in ks or [] if k} | {"Blue line"}
    want = [(i, tuple(sorted(f for f, of in topics.items() if any(t in (x or "") for t in {f} | of))), tuple(sorted(t for t in said if t in (x or "")))) for i, x in texts]
    assert sorted(((r["id"], tuple(r["files"]), tuple(r["terms"])) for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == (most_bytes < 1000)  # hits were joined twice, gathered twice and joined to the texts twice
    assert got.columns == ["id", "files", "terms"]
