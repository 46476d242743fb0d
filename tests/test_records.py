"""Records, rules and contexts against plain Python."""

import json
import random

from fathom.functions import canonical
from fathom.operators import governance, records, retrieval
from fathom.params import RetrievalSettings, embedding_fingerprint, evaluation_fingerprint, evaluation_profiles, pipeline_fingerprint
from pyspark.sql import functions as F
import pytest


def test_entities_and_relationships_as_texts(spark):
    nodes = [("n1", "Name", "t", "c", ["f", "", "g"], ["d2", "d1", "", "d2"]), ("n2", "", None, None, ["f", "g"], ["d1"]), ("n3", None, "", "", None, None)]
    got = {r["record_id"]: (r["text"], r["source_files"], r["document_id"]) for r in records.entity_records(spark.createDataFrame(nodes, "id string, label string, type string, category string, source_files array<string>, document_ids array<string>")).collect()}
    assert got == {
        "entity::n1::doc::d1": ("实体：Name\n类型：t\n分类：c\n来源文件：", [], "d1"),
        "entity::n1::doc::d2": ("实体：Name\n类型：t\n分类：c\n来源文件：", [], "d2"),
        "entity::n2::doc::d1": ("实体：n2\n类型：\n分类：\n来源文件：f、g", ["f", "g"], "d1"),
        "entity::n3": ("实体：n3\n类型：\n分类：\n来源文件：", [], ""),
    }
    edges = spark.createDataFrame([("a", "to", "b", "d", None, "f", None, None)], "source string, label string, target string, description string, evidence string, source_file string, document_id string, confidence double")
    (r,) = records.relationship_records(edges).collect()
    assert (r["record_id"], r["text"], r["confidence"]) == ("relationship::a->to->b", "关系：a to b\n描述：d\n证据：\n来源文件：f", 0.8)


def test_documents_of_categories(spark):
    rows = [("a", ["f1"], [("d9", "f9"), ("d8", "")]), ("b", ["f1", "f2", "f1", ""], None), ("c", None, [])]
    categories = spark.createDataFrame(rows, "category string, source_files array<string>, document_sources array<struct<document_id:string,source_file:string>>")
    docs = spark.createDataFrame([("d1", "f1"), ("d2", "f2"), ("d3", "f1"), ("d4", "f4"), (None, "f2")], "document_id string, source_file string")
    assert sorted(map(tuple, records.category_documents(categories, docs).collect())) == [("a", "d9", "f9"), ("b", "", "f2"), ("b", "d1", "f1"), ("b", "d2", "f2"), ("b", "d3", "f1")]


def test_schemas_keep_what_is_known(spark):
    fields = [("node", " id ", "Name", "string"), ("node", "id", "again", "string"), ("node", "secret", "no", "string"), ("node", "type", "x" * 50, "odd"), ("edge", "source", "", None), ("edge", "id", "", ""), ("other", "id", "", ""), ("node", None, "", "")]
    table = spark.createDataFrame([("s", k, i, key, label, t) for i, (k, key, label, t) in enumerate(fields)], "schema string, kind string, position int, key string, label string, type string")
    judged = records.schema_fields(table, ["schema"])
    got = {r["position"]: (r["key"], r["label"], r["type"], r["reason"]) for r in judged.collect()}
    assert got == {0: ("id", "Name", "string", ""), 1: ("id", "again", "string", "repeated"), 2: ("secret", "no", "string", "unknown"), 3: ("type", "x" * 32, "string", ""), 4: ("source", "source", "string", ""), 5: ("id", "id", "string", "unknown"), 6: ("id", "id", "string", "unknown"), 7: ("", "", "string", "unknown")}
    details = spark.createDataFrame([("s", "node", i, k) for i, k in enumerate(["id", "type", "id", "label"])] + [("s", "edge", 9, "source")], "schema string, kind string, position int, key string")
    assert {(r["kind"], r["position"]): r["reason"] for r in records.schema_details(details, judged, ["schema"]).collect()} == {("node", 0): "", ("node", 1): "", ("node", 2): "repeated", ("node", 3): "unknown", ("edge", 9): ""}
    visual = spark.createDataFrame([("s", 0, "node_color_by", "type"), ("s", 1, "node_color_by", "label"), ("s", 2, "edge_color_by", "secret"), ("s", 3, "size", "type")], "schema string, position int, key string, value string")
    assert {r["position"]: r["reason"] for r in records.schema_visuals(visual, ["schema"]).collect()} == {0: "repeated", 1: "", 2: "unknown field", 3: "unknown key"}
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    (r,) = records.projected(rows, [("id", "string"), ("none", "number"), ("also", "list"), ("", "string"), ("flag", "boolean")]).collect()
    assert r.asDict() == {"id": "a", "none": 0.0, "also": [], "flag": False}


def test_questions_are_checked(spark):
    raw = [(i, f"q{i}", f" question {i % 17} " if i % 5 else " ", ["tariffs", "x", "tar", "", None][i % 5]) for i in range(40)]
    table = spark.createDataFrame([("s", i, None if i == 1 else n, q, c) for i, n, q, c in raw], "set string, position int, id string, question string, category string")
    got = {r["position"]: r for r in records.generated_questions(table, ["set"], ["tariffs", "other"], ("x",)).collect()}
    seen, kept = set(), []
    for i, _, q, c in raw:
        q = q.strip()
        reason = "blank" if not q else "repeated" if q in seen else "beyond" if len(kept) >= records.MOST_QUESTIONS else ""
        if q and q not in seen:
            seen.add(q)
        kept += [i] if not reason else []
        assert got[i]["reason"] == reason, i
        assert got[i]["category"] == {"tariffs": "tariffs", "x": "x", "tar": "tariffs"}.get(c, "tariffs") and got[i]["id"] == ("llm_q_1" if i == 1 else f"q{i}")


def test_common_questions_and_names(spark):
    names = spark.createDataFrame([(0, "a"), (1, ""), (2, "b"), (3, "a")], "position int, name string")
    ask = lambda rows: [r["question"] for r in records.common_questions(rows, {"a": "About a? "}, "What of {}?", ("d1", "About a?", "d2", "d3", "d4")).orderBy("position").collect()]
    assert ask(names) == ["About a?", "What of b?", "d1", "d2", "d3"] and ask(names.limit(0)) == ["d1", "About a?", "d2", "d3", "d4"]
    many = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "position int, name string")
    assert ask(many) == [f"What of n{i}?" for i in range(10)]
    rules = [(("a", "b"), True, "first"), (("law",), False, "second")]
    name = lambda *values: records.fallback_name(spark.createDataFrame([(v,) for v in values], "name string"), rules, "none").first()[0]
    assert (name("x", "b"), name("some law"), name("y", None)) == ("first", "second", "none")
    summary = records.schema_summary(many.select("position", "name", F.lit(1).alias("document_count"), F.lit(2).alias("chunk_count"), F.array_repeat(F.lit("f"), 20).alias("source_files")), many.withColumnRenamed("name", "source_file"), many.withColumnRenamed("name", "section_title")).first()
    assert ([c["name"] for c in summary["categories"]], len(summary["categories"][0]["source_files"]), summary["source_files"], len(summary["section_titles"]), summary["chunk_count"]) == ([f"n{i}" for i in range(12)], 8, [f"n{i}" for i in range(16)], 24, 30)


def test_the_context_of_an_answer(spark):
    rng = random.Random(1)
    chunks = [(q, p, rng.choice(["f1", "", None]), "title", 'said "so"\n', rng.choice(["c", None])) for q in (1, 2) for p in (3, 1, 2)]
    paths = [(1, 2, "b -> to -> c -> of -> a", "", "f", "e", 0.5, "m"), (1, 1, "a -> to -> b", "d", None, None, 1.0, None)]
    got = records.answer_context(
        spark.createDataFrame(chunks, "q int, pos int, source_file string, section_title string, content string, category string"),
        spark.createDataFrame(paths, "q int, pos int, path string, description string, source_file string, evidence string, score double, match_source string"),
        spark.createDataFrame([(1,), (2,), (3,)], "q int"),
        ["q"],
    ).collect()

    def plain(q):
        own = sorted((c for c in chunks if c[0] == q), key=lambda c: c[1])
        told = sorted((p for p in paths if p[0] == q), key=lambda p: p[1])
        said = [{"reference_id": i, "source_file": c[2] or "", "section_title": c[3], "category": c[5] or "", "content": c[4]} for i, c in enumerate(own, 1)]
        relations = [{"path": p[2], "description": p[3] or "", "source_file": p[4] or "", "evidence": p[5] or "", "score": p[6], "match_source": p[7] or ""} for p in told]
        names = list(dict.fromkeys(x.strip() for p in told for i, x in enumerate(p[2].split("->")) if i % 2 == 0))
        block = lambda title, rows: f"{title}:\n\n```json\n{json.dumps(rows, ensure_ascii=False, indent=2)}\n```\n\n"
        files = "\n".join(f"[{c['reference_id']}] {c['source_file'] or 'unknown'}" for c in said)
        return block("Knowledge Graph Data (Entity)", [{"id": n, "label": n} for n in names]) + block("Knowledge Graph Data (Relationship)", relations) + block("Document Chunks", said) + f"Reference Document List:\n\n```\n{files}\n```\n"

    assert {r["q"]: r["context"] for r in got} == {q: plain(q) for q in (1, 2, 3)}


def test_fingerprints_of_settings():
    s = RetrievalSettings()
    one = embedding_fingerprint("remote", "m", "", "https://host/")
    assert one == embedding_fingerprint("remote", "m", "", "https://host") != embedding_fingerprint("local_onnx", "m", "", artifacts={"a": "1"})
    assert pipeline_fingerprint(s, one, "c", 2) != pipeline_fingerprint(s, one, "c", 3)
    assert evaluation_fingerprint("g", "p", {"mode": "fixed", "other": 1}, evaluation_profiles(s)) == evaluation_fingerprint("g", "p", {"mode": "fixed"}, evaluation_profiles(s))
    assert s.fingerprint == canonical.fingerprint_of(s.__dict__)


def test_replies_of_an_access_service(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    reply = spark.createDataFrame([("d1",), ("d1",)], "document_id string")
    assert [r[0] for r in governance.permitted(reply, "7", "7", docs).collect()] == ["d1"]
    for bad, revision in ((reply, "8"), (reply, None), (spark.createDataFrame([("",)], "document_id string"), "7"), (spark.createDataFrame([(None,)], "document_id string"), "7"), (spark.createDataFrame([("d3",)], "document_id string"), "7")):
        with pytest.raises(governance.Refused):
            governance.permitted(bad, revision, "7", docs)


def test_versions_of_one_time_are_an_error_or_decided(spark):
    rows = spark.createDataFrame([("a", 1, "published", 1), ("a", 2, "published", 1), ("b", 1, "published", 1), ("b", 2, "retired", 2), ("c", 1, "published", 3)], "document_id string, version int, status string, effective_at int")
    with pytest.raises(governance.VersionConflict, match="a"):
        governance.active_versions(rows, F.lit(2)).collect()
    assert [tuple(r) for r in governance.active_versions(rows, F.lit(2), "version").collect()] == [("a", 2, 1)]
    assert governance.active_versions(rows.where("document_id <> 'a'"), F.lit(5)).count() == 1


def test_chains_keep_every_record_and_refuse_stale_anchors(spark):
    day = [("x", None, i, f"p{i}") for i in range(3)] + [("x", "d", 1, "same"), ("x", "d", 1, "same"), ("x", "d", None, None), (None, None, 5, "q")]
    events = spark.createDataFrame(day, "log string, day string, n int, payload string")
    chain = lambda rows, anchored=None: governance.chain(rows, ["n"], F.col("payload"), ["log", "day"], anchored)
    whole = chain(events)
    assert whole.count() == len(day) and sorted(r["sequence"] for r in whole.where("day = 'd'").collect()) == [1, 2, 3]
    anchored = governance.anchors(whole, ["log", "day"])
    assert all(r["valid"] for r in governance.verify_chain(whole, anchored, F.col("payload"), ["log", "day"]).collect())
    first = chain(events.where("n = 0 or n = 1 or n is null or n = 5"))
    ends = governance.anchors(first, ["log", "day"])
    new, after = governance.append(first, ends, events.where("n = 2"), ["n"], F.col("payload"), ["log", "day"])
    every = first.unionByName(new)
    assert sorted(map(str, every.collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, after.collect())) == sorted(map(str, anchored.select(*after.columns).collect()))
    with pytest.raises(governance.StaleAnchor):
        governance.append(every, ends, events.where("n = 2"), ["n"], F.col("payload"), ["log", "day"])
    with pytest.raises(governance.StaleAnchor):
        governance.append(every.where("sequence < 3"), after, events.where("n = 2"), ["n"], F.col("payload"), ["log", "day"])


def test_budgets_of_many_questions_equal_a_loop(spark):
    rng = random.Random(4)
    tokens = lambda t: 0 if not t else sum("一" <= c <= "鿿" for c in t) + max(1, sum(not "一" <= c <= "鿿" for c in t) // 4)

    def cut(text, budget):
        if tokens(text) <= budget:
            return text
        used, out = 0, ""
        for c in text:
            used += 2 if "一" <= c <= "鿿" else 1
            if used > max(1, budget - 1):
                break
            out += c
        return out.rstrip() + "…"

    say = lambda n: "".join(rng.choice("ab 日本x ") for _ in range(n))
    asked = {q: say(rng.choice([0, 10, 300, 900])) for q in range(12)}
    chunks = {q: [say(rng.choice([5, 60, 400, 2000])) for _ in range(rng.randrange(5))] for q in asked}
    paths = {q: [("a -> b" + say(5), say(rng.choice([0, 50, 900])), say(rng.choice([0, 30, 600]))) for _ in range(rng.randrange(4))] for q in asked}
    got_c, got_p = retrieval.in_context(
        spark.createDataFrame(list(asked.items()), "q int, question string"),
        spark.createDataFrame([(q, i, t) for q, ts in chunks.items() for i, t in enumerate(ts)], "q int, pos int, content string"),
        spark.createDataFrame([(q, i, *p) for q, ps in paths.items() for i, p in enumerate(ps)], "q int, pos int, path string, description string, evidence string"),
        400,
        ["q"],
    )

    def loop(q):
        fixed = tokens(asked[q]) + 100
        budget, used, told = max(40, min(100, 400 - fixed)), 0, []
        for path, description, evidence in paths[q]:
            cost = tokens(path) + tokens(description) + tokens(evidence) + 12
            if cost <= budget - used:
                told.append((path, description, evidence))
                used += cost
                continue
            if not told and budget > 20:
                left = max(1, budget - tokens(path) - 12)
                p = (path, cut(description, left), evidence) if description else (path, description, cut(evidence, left))
                told.append(p)
                used += sum(map(tokens, p)) + 12
            break
        room, spent, said = max(60, 400 - fixed - used), 0, []
        for text in chunks[q]:
            cost = tokens(text) + 16
            if cost <= room - spent:
                said.append(text)
                spent += cost
                continue
            if not said and room > 20:
                said.append(cut(text, max(1, room - 16)))
            break
        return said, told

    said, told = {q: [] for q in asked}, {q: [] for q in asked}
    for r in got_c.orderBy("pos").collect():
        said[r["q"]].append(r["content"])
    for r in got_p.orderBy("pos").collect():
        told[r["q"]].append((r["path"], r["description"], r["evidence"]))
    assert {q: (said[q], told[q]) for q in asked} == {q: loop(q) for q in asked}


def test_keywords_of_a_question_equal_a_loop(spark):
    from fathom.operators import evidence
    from fathom.params import CHINESE_ENTITIES, CHINESE_HINTS, CHINESE_IMPLIED, CHINESE_INTENTS, CHINESE_PLACE_FIELD, CHINESE_PLACES
    from fathom.operators.corpus import entity_matches, implied_entities

    nodes = [("n2", "专线"), ("n1", ""), ("业务变更", "change"), ("n4", "材料")]
    edges = [("needs", "需要 材料", "e"), ("审核 of", "", "关系"), ("plain", "x", "y"), ("", "流程", "")]
    table = spark.createDataFrame(nodes, "id string, label string")
    links = spark.createDataFrame([("a", label, "b", d, e) for label, d, e in edges], "source string, label string, target string, description string, evidence string")

    def loop(question, intent, entities):
        named = [e for e in entities if e in question or e == intent] + [n for n, words in CHINESE_ENTITIES.items() if n in question or any(w in question for w in words)]
        named += [i for i, _ in sorted(nodes) if intent and i == intent]
        for i, label in sorted(nodes):
            named += [i] if i in question else [label or i] if (label or i) in question else []
        import re

        named += [t.strip() for t in re.findall(r"[\"“「『《]([^\"“”「」『』《》]{2,30})[\"”」』》]", question)]
        asked = [h for h in CHINESE_HINTS if h in question or h == intent] + ([CHINESE_PLACE_FIELD] if any(p in question for p in CHINESE_PLACES) else []) + ([intent] if any(t in intent for t in CHINESE_INTENTS) else [])
        labels = [x for x in sorted({e[0] for e in edges}) if x and (x in question or any(h in x for h in asked))]
        told = sorted({h for _, d, e in edges for h in CHINESE_HINTS if h in question and h in (d or e)})
        asked = asked + labels + told + re.findall("[A-Za-z0-9][A-Za-z0-9_-]+", question)
        both = [list(dict.fromkeys(named)), list(dict.fromkeys(asked))]
        return [x or ([question] if question else []) for x in both], not all(both)

    for question, intent in (("专线 n1 的 材料 在哪 “quoted term” AB-1", "合规审核"), ("nothing", "业务变更"), ("何时", ""), ("地址迁移 需要 plain 关系", "关系")):
        got = evidence.query_keywords(question, intent, table, links, list(CHINESE_HINTS), CHINESE_ENTITIES, (CHINESE_PLACES, CHINESE_PLACE_FIELD), CHINESE_INTENTS, ("given", "n1")).orderBy("kind", "pos").collect()
        (named, asked), fallback = loop(question, intent, ("given", "n1"))
        assert [r["keyword"] for r in got if r["kind"] == "entity"] == named and [r["keyword"] for r in got if r["kind"] == "relationship"] == asked, question
        assert {r["fallback"] for r in got} == {fallback}
    texts = ["欠费 了", "集团客户 的 资质", "材料", "地址迁移 与 销户"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(implied_entities(F.col("t"), entity_matches(F.col("t"), CHINESE_ENTITIES), CHINESE_IMPLIED)).collect()]
    assert found == [["退订销户"], ["企业客户", "合规审核"], [], ["业务变更", "退订销户", "合规审核"]]
    assert (evidence.graph_candidates(1), evidence.graph_candidates(5)) == (6, 15)


def test_scope_calls_references_and_approvals(spark):
    from fathom.functions import vectors
    from fathom.operators import corpus, evaluation

    rows = spark.createDataFrame([("a b c d e f key", ["f"] * 3, ["t"], ["e"] * 4), ("key bad", [], [], []), ("key", None, None, None)], "t string, files array<string>, terms array<string>, es array<string>")
    got = [r["v"] for r in rows.select(evaluation.scope_verdict(F.col("t"), ("bad",), ("key", "a", "b", "c", "d", "e ", "e"), ("f",), F.col("es"), F.col("files"), F.col("terms"), 0.12).alias("v")).collect()]
    assert [(v["in_scope"], v["score"], v["excluded"]) for v in got] == [(True, 1.0, []), (False, 0.55, ["bad"]), (True, 0.24, [])]
    calls = spark.createDataFrame([("c", "chat", None), ("c", "embedding", 3), ("c", "embedding", -2), ("c", "rerank", 5), ("c", "other", 9)], "case string, kind string, inputs int")
    assert evaluation.model_calls(calls, ["case"]).first().asDict() == {"case": "c", "total_calls": 4, "chat_calls": 1, "embedding_calls": 2, "embedding_inputs": 3, "rerank_calls": 1, "rerank_inputs": 5}
    refs, docs = spark.createDataFrame([("d1", 0), ("d2", 1), ("d3", 2)], "document_id string, rank int"), spark.createDataFrame([("d1", "published"), ("d2", "Retired")], "document_id string, status string")
    judged = {r["document_id"]: (r["acl_allowed"], r["is_active"], r["status"]) for r in evaluation.judged_references(refs, docs, docs.limit(1)).collect()}
    assert judged == {"d1": (True, True, "published"), "d2": (False, False, "Retired"), "d3": (False, False, "")}
    assert {r["acl_allowed"] for r in evaluation.judged_references(refs, docs, None).collect()} == {None}
    cases = spark.createDataFrame([("a", "q"), ("a", "q"), ("", "")], "case_id string, question string")
    assert sorted(r["problem"] for r in evaluation.dataset_problems(cases, {"schema_version": 1, "dataset_id": "x", "dataset_version": "1"}).collect()) == ["case without id", "case without question", "duplicate case id"]
    assert sorted(r["problem"] for r in evaluation.dataset_problems(cases.limit(0), {"schema_version": True, "dataset_id": " "}).collect()) == ["no cases", "no dataset_id", "no dataset_version", "unsupported schema version: True"]
    old = spark.createDataFrame([("g", "s1", "p0", "f0", 1), ("h", "s1", "p0", "f0", 1)], "generation string, fingerprint string, profile string, dataset_fingerprint string, approved_at int")
    profiles = spark.createDataFrame([("p1", "s1", True), ("p2", "s2", False), ("p3", "s3", None), ("p4", "s4", True)], "profile string, fingerprint string, passed boolean")
    after = governance.record_approvals(old, profiles, "g", "f1", True, F.lit(2))
    assert sorted(map(tuple, after.collect())) == [("g", "s1", "p1", "f1", 2), ("g", "s4", "p4", "f1", 2), ("h", "s1", "p0", "f0", 1)]
    assert governance.record_approvals(old, profiles, "legacy", "f1", True, F.lit(2)).count() == governance.record_approvals(old, profiles, "g", "f1", False, F.lit(2)).count() == 2
    by = corpus.rollup_by_document(spark.createDataFrame([("c", "d1", "f", ["k", "j"]), ("c", None, "f", ["k"])], "category string, document_id string, source_file string, keywords array<string>"), spark.createDataFrame([("c", "d1"), ("c", "d1"), ("x", "d2"), ("c", "")], "category string, document_id string"))
    assert sorted(map(str, by.collect())) == sorted(map(str, spark.createDataFrame([("c", "d1", "f", 2, ["j", "k"]), ("x", "d2", "", 1, [])], "category string, document_id string, source_file string, chunk_count long, keyword_hits array<string>").collect()))
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [3.0, 4.0], [0.0, 0.0])], "s array<array<double>>, m array<int>, u array<double>, z array<double>")
    r = v.select(vectors.pooled(F.col("s"), F.col("m")).alias("mean"), vectors.pooled(F.col("s"), F.col("m"), True).alias("last"), vectors.unit(F.col("u")).alias("unit"), vectors.unit(F.col("z")).alias("zero"), vectors.yes_share(F.lit(0.0), F.lit(0.0)).alias("half")).first()
    assert (r["mean"], r["last"], r["unit"], r["zero"], r["half"]) == ([2.0, 3.0], [3.0, 4.0], [0.6, 0.8], [0.0, 0.0], 0.5)


def test_questions_where_none_was_made_up(spark):
    ask = records.Question
    templates = {"a": ask("q_a", "About a?", "a", "rule", ("vector",), sources=("a", "b"))}
    otherwise = ask("q_{}", "Sum up {}.", "{}", "rule", ("vector",), sources=("{}",))
    more = [ask("r1", "Does x change y?", "change", "relation", ("graph", "hybrid"), paths=True, sources=("a", "none")), ask("again", "About a?", "a", "rule", ()), ask("edge", "Not here?", "out", "edge", ("vector",), references=False, intent="audit")]
    table = lambda names: spark.createDataFrame([(i, n, [f"{n}.txt"]) for i, n in enumerate(names)], "position int, name string, source_files array<string>")
    got = records.fallback_questions(table(["b", "a", ""]), templates, otherwise, more, ("d", "e", "f", "g", "h")).orderBy("position").collect()
    assert [(r["id"], r["expected_sources"], r["intent"], r["paths"], r["references"]) for r in got] == [
        ("q_b", ["b.txt"], "b", False, True), ("q_a", ["a.txt", "b.txt"], "a", False, True), ("r1", ["a.txt"], "change", True, True), ("edge", [], "audit", False, False), ("q_d", [], "d", False, True), ("q_e", [], "e", False, True), ("q_f", [], "f", False, True),
    ]
    many = records.fallback_questions(table([f"n{i}" for i in range(20)]), templates, otherwise, more * 4, ("d",)).collect()
    assert len(many) == 10 and sorted(r["position"] for r in many) == list(range(1, 11))


def test_titles_are_topics_and_numerals_are_headings(spark):
    from fathom.operators import chunking, corpus
    from fathom.params import CHINESE_HEADING

    docs = spark.createDataFrame([("d", "v1 Travel costs 2024-01-02.txt", "c", 'speaks of “Blue line” and tokens')], "document_id string, source_file string, category string, content string")
    topics = lambda titles: sorted(r["topic"] for r in corpus.memberships(docs, {"token": ("token",)}, titles).collect())
    assert topics(False) == ["token"] and topics(True) == ["Blue line", "Travel costs", "token"]
    text = spark.createDataFrame([("前言\n一、总则\n内容\n第二、范围\n（三）附则\n4．其他\n三人",)], "t string")
    assert text.select(chunking.units(F.col("t"), CHINESE_HEADING)).first()[0] == ["前言", "一、总则\n内容", "第二、范围", "（三）附则", "4．其他\n三人"]


def test_graphs_are_read_or_static(spark, tmp_path):
    from fathom.sources.graph import read_graph

    nodes, edges = spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("s", "l", "t")], "source string, label string, target string")
    read = lambda name: read_graph(spark, str(tmp_path / name), nodes, edges)
    graph = {"nodes": [{"id": "a", "label": "A", "source_files": ["f"]}, {"label": "only"}], "edges": [{"source": "a", "target": "b", "relation": "to", "confidence": 0.5}, {"source": "a"}], "other": 1}
    (tmp_path / "good.json").write_text(json.dumps(graph, indent=1))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "empty.json").write_text('{"nodes": [], "edges": []}')
    got = read("good.json")
    assert got[2] == "dynamic_graph" and sorted(r["id"] for r in got[0].collect()) == ["a", "only"] and [(r["source"], r["label"], r["target"], r["confidence"]) for r in got[1].collect()] == [("a", "to", "b", 0.5)]
    for name in ("bad.json", "empty.json", "none.json"):
        assert read(name)[2] == "static_graph" and read(name)[1].count() == 1
