"""Graph search and the evidence tools against loops on small tables."""

import random
import re

from fathom.operators import evidence

HIT = "pos int, chunk_id string, document_id string, parent_chunk_id string, granularity string, source_file string, content string, score double"
EDGE = "source string, label string, target string, description string, evidence string, source_file string, document_id string, confidence double"


def _grams(text):
    t = text.casefold()
    plain, words = re.sub("[^a-z0-9]", "", t), re.findall("[a-z0-9]+", t)
    chars = {plain[i : i + 3] for i in range(max(1, len(plain) - 2))} if plain else set()
    return {("c", c) for c in chars} | {("w", " ".join(words[i : i + 2])) for i in range(max(1, len(words) - 1)) if words}


def _loop(streams, parents, k, candidates):
    """Streams in turn, parents, near copies: hit by hit."""
    merged, seen = [], set()
    for i in range(max(map(len, streams))):
        for s in streams:
            if i < len(s) and s[i][1] not in seen and len(merged) < candidates:
                seen.add(s[i][1])
                merged.append(s[i])
    grown = []
    for _, chunk, doc, parent, kind, file, text, score in merged:
        if kind in evidence.CHILDREN and (doc, parent) in parents:
            grown.append([parent, doc, parents[doc, parent], score, chunk])
        else:
            grown.append([chunk, doc, text, score, None])
    once = {}
    for hit in grown:
        if hit[0] not in once or hit[3] > once[hit[0]][3]:
            once[hit[0]] = hit
    kept = []
    for hit in once.values():
        for i, other in enumerate(kept):
            a, b = _grams(hit[2]), _grams(other[2])
            if hit[1] == other[1] and a and b and len(a & b) >= 0.85 * len(a | b):
                if hit[3] > other[3]:
                    kept[i] = hit
                break
        else:
            kept.append(hit)
    return [tuple(h) for h in kept[:k]]


def test_hybrid_tool_equals_a_loop(spark):
    rnd = random.Random(3)
    base = ["the quick brown fox jumps over the lazy dog near the river", "a very different sentence about licences and their many terms", "short"]
    units = []
    for i in range(60):
        text = rnd.choice(base) + rnd.choice(["", "", "!", " indeed"])
        units.append((f"u{i}", f"d{i % 5}", f"p{i % 7}" if i % 3 else None, rnd.choice(["paragraph", "sentence", "document"]), f"f{i % 4}", text, rnd.randrange(100) / 100))
    known = {(f"d{i % 5}", f"p{j}"): f"parent {i % 5} {j} " + rnd.choice(base) for i in range(5) for j in range(5)}
    parents = spark.createDataFrame([(p, d, "document", "pf", t) for (d, p), t in known.items()], "chunk_id string, document_id string, granularity string, source_file string, content string")
    streams = []
    for n in (6, 5, 20):
        some = rnd.sample(units, n)
        streams.append([(i + 1, *u) for i, u in enumerate(some)])
    df = [spark.createDataFrame(s, HIT) for s in streams]
    paths = spark.createDataFrame([(1, "a -> b -> c")], "pos int, path string")
    for k, candidates in ((10, 24), (4, 12)):
        got = evidence.hybrid_tool(df[0], evidence.Found(df[1], paths, "x"), df[2], parents, k, candidates)
        rows = [(r["chunk_id"], r["document_id"], r["content"], r["score"], r["matched_chunk_id"]) for r in got.chunks.orderBy("pos").collect()]
        assert rows == _loop([streams[0][:k], streams[1][:k], streams[2]], known, k, candidates)
    (path,) = got.paths.collect()
    assert path["path"] == "a -> b -> c"


def test_graph_search_falls_back_in_order(spark):
    edges = spark.createDataFrame([("a1", "owns", "b1", "", "a1 owns b1", "f1", "d1", 0.9), ("b1", "near", "c1", "b1 is near c1", "", "f2", "d2", None)], EDGE)
    nodes = spark.createDataFrame([("a1", "a1"), ("b1", "b1 the thing"), ("c1", "c1")], "id string, text string")
    chunks = spark.createDataFrame([("x", "d1", None, "document", "f1", "says a1 owns b1 here", "k"), ("y", "d2", None, "document", "f3", "nothing of it", "k"), ("z", "d2", None, "document", "f2", "thing", "other")], "chunk_id string, document_id string, parent_chunk_id string, granularity string, source_file string, content string, category string")
    some = spark.createDataFrame([("b1", 0.7)], "id string, score double")
    none, no_relation = some.limit(0), spark.createDataFrame([], "source string, label string, target string, score double")
    search = lambda hits, question, terms, **o: evidence.graph_search(chunks, nodes, edges, hits, no_relation, question, "k", terms, 2, **o)
    found = search(some, "?", ["thing"])
    assert found.source == "graph_vector_mix" and [(r["path"], r["score"]) for r in found.paths.orderBy("pos").collect()] == [("a1 -> owns -> b1", 0.9), ("b1 -> near -> c1", 0.8)]
    # x: category, then file and evidence; z: keyword and file.
    assert [(r["chunk_id"], r["score"]) for r in found.chunks.orderBy("pos").collect()] == [("x", 1.0), ("z", 1.0)]
    found = search(none, "what of c1", ["thing"])
    assert found.source == "dynamic_literal" and {(r["path"], r["score"]) for r in found.paths.collect()} == {("a1 -> owns -> b1", 0.57), ("b1 -> near -> c1", 0.64)}
    found = search(none, "?", ["unheard"])
    assert found.source == "governed_text" and found.paths.isEmpty() and [r["chunk_id"] for r in found.chunks.orderBy("pos").collect()] == ["x", "y"]
    found = search(none, "?", ["zz"], governed=False, static=spark.createDataFrame([("zz", "to", "q", "s")], "source string, label string, target string, source_file string"))
    assert found.source == "static_graph" and [r["path"] for r in found.paths.collect()] == ["zz -> to -> q"]


def test_boost_of_chunks_for_paths(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"f{i % 3}", ["b1 said", "none", "proof"][i % 3] + str(i), "k" if i % 2 else "o") for i in range(12)], "chunk_id string, source_file string, content string, category string")
    paths = spark.createDataFrame([(1, "a1 -> owns -> b1", "f0", ""), (2, "x -> y -> w", "", "proof")], "pos int, path string, source_file string, evidence string")
    got = [(r["chunk_id"], r["score"]) for r in evidence.path_chunks(chunks, paths, "k", ["none"], 3).orderBy("pos").collect()]
    base = sorted(((-(0.45 + 0.2 * (c["category"] == "k") + 0.08 * ("none" in c["content"])), c["chunk_id"], c) for c in chunks.collect()), key=lambda x: x[:2])[:12]
    parts = {"a1", "owns", "b1", "x", "y", "w", "proof"}
    want = sorted((-round(min(1, -s + 0.65 * (c["source_file"] == "f0") + 0.25 * any(p in c["content"] for p in parts)), 4), i) for s, i, c in base)[:3]
    assert got == [(i, -s) for s, i in want]


def test_near_copies_without_a_document_stay_apart(spark):
    rows = [(1, "a", None, None, "document", None, "same words here", 0.5), (2, "b", "", None, "document", "", "same words here", 0.9), (3, "c", None, None, "document", "f", "same words here", 0.1), (4, "d", None, None, "document", "f", "same words here", 0.2)]
    got = [(r["pos"], r["chunk_id"]) for r in evidence.without_near_copies(spark.createDataFrame(rows, HIT)).orderBy("pos").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "d")]
