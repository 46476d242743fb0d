"""Queries that look at all of their tables, on small tables made for it."""

import hashlib
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from fathom import session
from fathom.functions import text as T
from fathom.operators import batch, evidence, index, retrieval
from fathom.params import LATIN, RetrievalSettings, evaluation_profiles
from fathom.plans import batch as plans
from fathom.plans import corpus as plans_of_corpus
from fathom.plans import library
from fathom.sources import office
from fathom.sources.make import docx, pptx, xlsx
from pyspark.sql import functions as F


def test_idle_customers_have_no_order_of_any_year(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.createDataFrame([(1, "1995-03-01 00:00:00"), (2, "2001-02-01 00:00:00")], "o_custkey long, o_orderdate string")
    orders.selectExpr("o_custkey", "cast(o_orderdate as timestamp) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r[0] for r in library.QUERIES["anti_join_idle_customers"](spark, str(tmp_path)).collect()] == [3]


def _written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_index_searches_make_no_row_a_text_and_question(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i:04}", "the fox " * (i % 3 + 1), f"c{i % 4}", f"f{i % 5}") for i in range(500)], "chunk_id string, content string, category string, source_file string")
    questions = spark.createDataFrame([(q, ["the", "fox"], f"c{q % 4}", ["f1"]) for q in range(600)], "question_id long, terms array<string>, category string, files array<string>").repartition(4)
    index.build_postings(units, str(tmp_path / "p"), buckets=8)
    for search in (index.term_index_search, index.keyword_index_search):
        before = _written(spark)
        found = search(spark, str(tmp_path / "p"), units, questions, 5).collect()
        assert len(found) == 3000 and _written(spark) - before < 500_000  # 300,000 pairs of a text and a question take more


def test_the_best_of_many_questions_are_arrays():
    n, k, rng = 20_000, 20, np.random.default_rng(3)
    ids, question = pa.array([f"unit-{i:06}" for i in range(60)]), np.arange(n)
    tracemalloc.start()
    best, all_scores = batch.Best(n, k), []
    for row in range(60):
        all_scores.append(rng.integers(0, 9, n) / 8)
        best.add(question, np.full(n, row), all_scores[-1], ids)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size - 60 * n * 8 < 20e6  # a list of tuples a question takes 60 MB and more
    got = pa.Table.from_batches(best.batches(np.arange(n), pa.string())).to_pandas()
    for q in (0, 1, 777, n - 1):
        own = sorted((-s[q], i) for i, s in zip(ids.to_pylist(), all_scores, strict=True))[:k]
        assert sorted((-s, i) for s, i in got[got.number == q][["score", "id"]].itertuples(index=False)) == own


def test_questions_are_compared_with_their_own_category_first(spark, monkeypatch):
    rows = [(f"u{i:04}", "fox and river" if i % 2 else "the fox", f"c{i % 4}", f"f{i % 5}") for i in range(400)]
    units = spark.createDataFrame(rows, "chunk_id string, content string, category string, source_file string")
    questions = spark.createDataFrame([(q, ["fox", "river"], f"c{q % 5}", ["f1"]) for q in range(20)], "question_id long, terms array<string>, category string, files array<string>")
    looks, told = [], batch._Told.__init__
    monkeypatch.setattr(batch._Told, "__init__", lambda self, block, own: looks.append((len(block), own)) or told(self, block, own))
    found = batch.keyword_batch(units, questions, 3).collect()
    assert looks == [(20, True), (4, False)]  # c4 has no rows
    for r in found:
        want = f"c{r['question_id'] % 5}"
        scored = sorted((-(0.45 + 0.2 * (c == want) + 0.08 * sum(t in x for t in ("fox", "river")) + 0.05 * (f == "f1")), i) for i, x, c, f in rows)
        assert r["chunk_id"] == scored[r["pos"] - 1][1]


SF = "/root/testdata/sf0.001"


def _noise(n, size, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(map(chr, rng.integers(97, 123, size))) for _ in range(n)]


def test_texts_do_not_go_on_to_questions(spark):
    rows = [(f"u{i:04}", x, "c1", "f1", np.random.default_rng(i).standard_normal(8).tolist()) for i, x in enumerate(_noise(200, 10_000))]
    units = spark.createDataFrame(rows, "chunk_id string, content string, category string, source_file string, embedding array<double>")
    questions = spark.createDataFrame([(q, "q", np.random.default_rng(q).standard_normal(8).tolist(), "c1", ["aa"], ["f1"]) for q in range(60)], "question_id long, question string, query array<double>, category string, entities array<string>, files array<string>")
    settings = batch.question_settings({"a": RetrievalSettings(top_k=3, candidate_k=20, min_score=0.0)}, questions, LATIN)
    most, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert batch.vector_batch(units, questions, settings).count() == 60 * 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert _written(spark) - before < 2_000_000  # 1,200 hits with their texts have 12 MB


def test_centres_are_fitted_in_slices():
    x = np.random.default_rng(1).standard_normal((20_000, 8))
    tracemalloc.start()
    assert index.centres(x, 1500, 1, 1).shape == (1500, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all products at once have 240 MB


def test_hits_are_hashed_where_they_are_folded(spark):
    rows = [(f"d{i % 40}", f"h{i}", x, i / 7 % 1, i) for i, x in enumerate(_noise(1000, 600))]
    hits, before = spark.createDataFrame(rows, "scope string, id string, content string, score double, pos int"), _written(spark)
    assert retrieval.near_dup_greedy(hits, "scope", "id", "content", "score", "pos").count() == 1000
    assert _written(spark) - before < 2_000_000  # sets of hashes have 5 MB


def test_digests_of_shingles(spark):
    texts = [None, "", " -", "a", "ab", "abc", "a b", "A b c", "\u65e5\u672c", "\u65e5 a", "\u65e5\u672c\u8a9e ab \u00df", "\u00c4\u00d6 \u00e9", "the the the", "x" * 5000]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(T.shingle_digest(F.col("t")).alias("s"), T.shingles(F.col("t")).alias("e")).select("s.*", "e").collect()
    want = [(len(r["e"] or []), hashlib.sha256("|".join(sorted(r["e"])).encode()).hexdigest() if r["e"] else None) for r in got]
    assert [(r["n"], r["digest"]) for r in got] == want


def test_contexts_ask_for_one_profile_and_tools_join_units_once(spark):
    settings = plans._tool(spark, SF, "parent_context_enabled")[2]
    assert {r[0] for r in settings.select("profile").distinct().collect()} == {"parent_context_enabled"}
    plan = library.QUERIES["hybrid_tool"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [doc_id" not in plan  # units are read from what was joined once


def test_files_are_made_and_read_once(spark):
    plan = library.QUERIES["office_files"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1 and plan.count("MapInArrow") == 2  # a branch a kind had three of all


def test_large_parts_of_office_files_say_the_same(monkeypatch):
    lines = [f"line {i} <&> 日" for i in range(40)]
    made = {"docx": docx(lines), "pptx": pptx(lines), "xlsx": xlsx([x.split(" ") for x in lines])}
    at_once = {k: office.text_of(x, k) for k, x in made.items()}
    monkeypatch.setattr(office, "SMALL", 0)
    assert {k: office.text_of(x, k) for k, x in made.items()} == at_once
    assert at_once["docx"].split("\n") == lines and at_once["xlsx"].count("\n") == 40 and at_once["pptx"].count("\n") == 79


def test_cleaned_texts(spark):
    texts = [None, "", " ", "\r", "a\r\nb\rc\n\n d ", "\ufeffa\u200b\x00b\x7f \t c\t", "\u3000\u00a0x \u2003 y\u2028\u0085", "x\u2028", "\u2028\n\u2029x\n", "\U0001f600 \U0001f600\t\t\U0001f600  ", " \ta\x0b\x0c \n\x1f\n", "\r\u200b\nq", "e\u200a\u200c\ufefe\uff00"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(T.clean(F.col("t"))).collect()]

    def cleaned(x):
        x = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(r"\r\n?", "\n", re.sub("[\ufeff\u200b]", "", x)))
        blank = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
        return "\n".join(filter(None, (re.sub(r"[ \t]+", " ", y).strip(blank) for y in x.split("\n"))))

    assert got == [None if x is None else cleaned(x) for x in texts]


def test_near_sets_share_enough_keys():
    p, rng = retrieval.Pieces(0.85), np.random.default_rng(7)
    for n in [*range(7, 60), 100, 333, 905, 2500] * 3:
        most = int(n / 0.85 + 1e-9) - n  # the last of them has just the threshold
        extra = int(rng.integers(0, most + 1))
        large = np.unique(rng.integers(0, 1 << 63, n + extra).astype(np.uint64)).view(np.int64)
        small = np.delete(large, rng.choice(len(large), extra, replace=False))
        i, j = p.interval(len(small)), p.interval(len(large))
        assert j in (i, i + 1)
        shared = len(np.intersect1d(p.keys(small, i), p.keys(large, i)))
        assert shared >= p.dealt(i)[2] or extra == 0 and n < 7
    # Texts of the same few shingles have a first shingle in common, but hardly a piece.
    words = [f"w{i}" for i in range(300)]
    sets = [T.hashed_shingles(" ".join(rng.choice(words, 400))) for _ in range(150)]
    keys = [set(p.keys(s, p.interval(len(s))).tolist()) for s in sets]
    assert sum(len(a & b) for k, a in enumerate(keys) for b in keys[:k]) < 150


def test_near_classes_hash_texts_once_and_keep_rows_without_scope(spark):
    rows = [(1, "a", "the fox and the river run " * 9), (2, "a", "The fox, and the river run " * 9), (3, "a", ""), (4, None, "the fox"), (5, "b", None), (6, "a", "the fox and the river run " * 9 + "off")]
    members, links = retrieval.near_dup_classes(spark.createDataFrame(rows, "doc_id int, scope string, content string"), "scope", "doc_id", "content")
    assert "Python" not in members._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["class_id"], r["copies"]) for r in members.collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1)]
    assert [(r["a"], r["b"]) for r in links.collect()] == [(1, 6)]


def test_shingles_go_on_in_portions(spark, monkeypatch):
    docs, held = spark.createDataFrame([(1, "a", "x")], "id long, scope string, content string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: held.append(f))
    retrieval._sets(docs, "scope", "id", "content")
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 600), pa.array(range(600)), pa.array(_noise(600, 4000))], ["scope", "id", "_text"])
    got = [(b.num_rows, len(b.column(2).flatten())) for b in held[0](iter([batch]))]
    assert sum(n for n, _ in got) == 600 and sum(m for _, m in got) > 1_500_000 and max(m for _, m in got) < retrieval.PORTION + 5000


def test_near_pairs_give_workers_small_batches_and_keep_scopes_apart(spark, monkeypatch):
    key, asked = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    texts = spark.range(3000).coalesce(1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    got = [r["n"] for r in session.cut(texts.mapInArrow(sizes, "n long"), 1 << 18).collect()]
    assert sum(got) >= 3_000_000 and max(got) < 1 << 19 and spark.conf.get(key) == before

    def cut(df, batch_bytes=None):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            asked.append(batch_bytes)
        return session.cut(df, batch_bytes)

    monkeypatch.setattr(retrieval, "cut", cut)
    text = "the fox and the river run " * 9
    rows = [(i, scope, x) for scope in "ab" for i, x in enumerate([text + "off", text, _noise(1, 900)[0]])] + [(3, "b", text + "on"), (4, "b", text)]
    found = retrieval.near_dup_pairs(spark.createDataFrame(rows, "id long, scope string, content string"), "scope", "id", "content").collect()
    sets = {(s, i): set(T.hashed_shingles(x).tolist()) for i, s, x in rows}
    near = lambda x, y: len(x & y) >= 0.85 * len(x | y)
    assert sorted((r["scope"], r["a"], r["b"]) for r in found) == sorted((s, i, j) for s, i in sets for t, j in sets if s == t and i < j and near(sets[s, i], sets[t, j]))
    assert asked == [retrieval.BATCH_BYTES] * 2


def test_the_sweep_has_profiles_without_near_copies(spark, tmp_path):
    """All twelve profiles, and DuckDB's rows, where half the texts of a group nearly repeat each other."""
    for name in ("embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    told = F.concat(F.repeat(F.concat(F.lit("the fox of "), F.col("doc_id") % 40, F.lit(" and the river run ")), 20), F.when(F.col("doc_id") % 3 == 0, F.lit("off")).otherwise(F.lit("")))
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 4 < 2, told).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = plans.evaluation_sweep(spark, str(tmp_path))
    told = con.execute(library.SQL["evaluation_sweep"])
    columns = [d[0] for d in told.description]
    got = {r["profile"]: tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in columns) for r in found.collect()}
    assert got == {r[columns.index("profile")]: tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in told.fetchall()}
    assert set(got) == set(evaluation_profiles(RetrievalSettings())) and got["dedup_enabled"][1:] != got["baseline_new_retrieval"][1:]


def test_hits_without_others_of_their_size_have_no_near_copy(spark):
    rows = [("p", 1, i, "d" if i < 5 else "e", n) for i, n in enumerate([100, 117, 50, 0, 0, 100, 118])]
    hits = spark.createDataFrame(rows, "profile string, question_id int, pos int, document_id string, n int").withColumn("source_file", F.lit("f"))
    got = hits.withColumn("close", evidence.may_repeat(hits, "n", 0.85, batch.SCOPE)).where("close").collect()
    assert sorted(r["pos"] for r in got) == [0, 1]


def test_near_sets_share_enough_rare_keys():
    rng = np.random.default_rng(11)
    for n in [*range(1, 80), 333, 905, 2500] * 2:
        rarity = rng.integers(0, 4, 1 << retrieval.RARITY_BITS).astype(np.uint8)  # whatever the order
        extra = int(rng.integers(0, int(n / 0.85 + 1e-9) - n + 1))
        large = np.unique(rng.integers(0, 1 << 63, n + extra).astype(np.uint64) << np.uint64(1)).view(np.int64)
        large.sort()
        small = np.delete(large, rng.choice(len(large), extra, replace=False))
        keys = [retrieval.rare_keys(x, rarity, 0.85) for x in (small, large)]
        assert len(np.intersect1d(*keys)) >= retrieval.shared_keys(len(small)) and all(len(k) <= 0.15 * n / 0.85 + 5 for k in keys)


def test_near_classes_write_keys_not_sets_and_compare_few(spark, monkeypatch):
    """Texts of one passage aren't compared, all near copies of a large group are, in cells, and what is written is small."""
    passage, compared, kept = _noise(1, 200)[0], [], []
    texts = [f"{x} {passage}" for x in _noise(40, 3000)] + [passage * 3 + f" {i} off{i % 7}" for i in range(90)]
    whole = retrieval._compared
    monkeypatch.setattr(retrieval, "_compared", lambda pairs, *more: compared.append(pairs.count()) or whole(pairs, *more))
    monkeypatch.setattr(retrieval, "cut", lambda df, *more: kept.append(session.cut(df, *more)) or kept[-1])
    monkeypatch.setattr(retrieval, "CELL", 8)
    rows = spark.createDataFrame([(i, "a", x) for i, x in enumerate(texts)], "doc_id int, scope string, content string")
    _, links = retrieval.near_dup_classes(rows, "scope", "doc_id", "content")
    sets = [set(T.hashed_shingles(x).tolist()) for x in texts]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    assert {(r["a"], r["b"]) for r in links.collect()} == near and len(near) > 3000 and links.count() == len(near)
    assert compared[0] <= len(near) + 10
    written = sum(len(x) for df in kept for c, kind in df.dtypes if kind in ("array<int>", "array<bigint>") for (x,) in df.select(c).where(f"{c} is not null").collect())
    assert written < 0.6 * sum(map(len, sets))


def test_tools_scan_each_chunk_once_for_all_profiles(spark, monkeypatch):
    rows = [(f"u{i}", "d", None, [None, "paragraph", "document"][i % 3], "f", f"the fox {i}", "c", [1.0, float(i)]) for i in range(30)]
    units = spark.createDataFrame(rows, "chunk_id string, document_id string, parent_chunk_id string, granularity string, source_file string, content string, category string, embedding array<double>")
    questions = spark.createDataFrame([(1, "q", "hybrid", [1.0, 2.0], "c", ["fox"], ["f"], ["fox"])], "question_id long, question string, mode string, query array<double>, category string, entities array<string>, files array<string>, terms array<string>")
    scanned = {"nearest": [], "term_batch": []}
    for name in scanned:
        whole = getattr(batch, name)
        monkeypatch.setattr(batch, name, lambda rows, *more, name=name, whole=whole: scanned[name].extend(r[0] for r in rows.select("chunk_id").collect()) or whole(rows, *more))
    settings = batch.question_settings({"whole": RetrievalSettings(), "parts": RetrievalSettings(multi_vector_enabled=True)}, questions, LATIN)
    assert batch.tool_batch(units, units, questions, settings).count() == 4
    assert all(sorted(ids) == sorted(f"u{i}" for i in range(30)) for ids in scanned.values())


def test_graph_edges_are_made_once_for_all_that_is_said_of_them(spark, tmp_path):
    rows = [(1, "Apache license, a token", "src1"), (1, "the secret", "src1"), (1, "the secret", "src1"), (2, None, "src2"), (3, "MIT License", None), (None, "token and", "src1"), (4, "", ""), (5, "plain and TOKEN", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' lang").write.parquet(f"{tmp_path}/documents.parquet")

    members = [tuple(r) for r in plans_of_corpus._members(spark, str(tmp_path)).select("document_id", "source_file", "category", "topic").collect()]
    behind = {}
    for document, file, category, topic in members:
        file_node, category_node, topic_node = (None if x is None else f"{kind}:{x}" for kind, x in (("file", file), ("category", category), ("topic", topic)))
        for edge in ((category_node, "contains", file_node), (file_node, "mentions", topic_node), (category_node, "relates", topic_node)):
            if edge[2] is not None:
                behind.setdefault((*edge, file), set()).add(document)
    want = {edge: len(found - {None}) for edge, found in behind.items()}

    edges = library.QUERIES["graph_edges"](spark, str(tmp_path))
    assert {tuple(r)[:4]: r["evidence"] for r in edges.collect()} == want and edges.count() == len(want)
    stats = library.QUERIES["graph_stats"](spark, str(tmp_path))
    ends = {n for edge in want for n in (edge[0], edge[2])} - {None}
    assert stats.columns == ["nodes", "edges", "source_files", "evidence"]
    assert tuple(stats.first()) == (len(ends), len(want), len({edge[3] for edge in want} - {None}), sum(want.values()))
    scans = [found._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id") for found in (edges, stats)]
    assert scans == [1, 0]  # a branch a kind of edge had three, and ends and totals six; they are made of edges that are there

    spark.createDataFrame([], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tuple(library.QUERIES["graph_stats"](spark, f"{tmp_path}/none").first()) == (0, 0, 0, None)
