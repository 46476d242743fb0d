"""Whole ways from a question to evidence: graph search with its fallbacks, and the vector, graph and hybrid tools.

Hits have: pos (from 1), chunk_id, document_id, parent_chunk_id, granularity, source_file, content, score. Edges have:
source, label, target, description, evidence, source_file, document_id, confidence (null: 0.8); nodes have id and text.
A tool's hits are as few as its settings say, so one task ranks them. Chunks, nodes, edges and paths may be any number:
they are filtered, joined and, where all have a place, numbered part by part."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from fathom.functions.text import quoted_terms
from fathom.operators import corpus, retrieval
from fathom.operators.terms import contains_any, term_hits
from fathom.session import cut, numbered
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHILDREN = ("paragraph", "sentence")
HIT = ("chunk_id", "document_id", "parent_chunk_id", "granularity", "source_file", "content", "score")


@dataclass(frozen=True)
class Found:
    """Hits and relation paths of a question, both with pos, and where the paths come from."""

    chunks: DataFrame
    paths: DataFrame
    source: str


def placed(rows: DataFrame, *order: Column | str, scope: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))


# -- graph ------------------------------------------------------------------------------------------------------------


def as_paths(edges: DataFrame, match: str) -> DataFrame:
    """Scored edges as relation paths; the description falls back to the evidence."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return edges.select(
        F.concat_ws(" -> ", "source", "label", "target").alias("path"),
        text(F.coalesce(F.nullif("description", F.lit("")), F.col("evidence"))).alias("description"),
        text(F.col("source_file")).alias("source_file"),
        text(F.col("document_id")).alias("document_id"),
        text(F.col("evidence")).alias("evidence"),
        F.round("score", 4).alias("score"),
        F.lit(match).alias("match_source"),
    )


def _confidence() -> Column:
    return F.coalesce("confidence", F.lit(0.8))


def local_paths(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end among the entity hits (id, score): the best of both scores and the edge's confidence, 1 at
    most. Two equi-joins, then one row an edge."""
    ends = [edges.join(F.broadcast(hits.select(F.col("id").alias(c), F.col("score").alias("_s"))), c) for c in ("source", "target")]
    both = reduce(DataFrame.unionByName, ends)
    best = both.groupBy(*edges.columns).agg(F.max("_s").alias("_s"))
    return as_paths(best.withColumn("score", F.least(F.lit(1.0), F.greatest("_s", _confidence()))), "entity_vector")


def global_paths(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationship hits with what their edge (source, label, target) says; the hit's own where there is no edge."""
    keys, told = ["source", "label", "target"], ["description", "evidence", "source_file", "document_id"]
    known = edges.join(F.broadcast(hits.select(*keys).distinct()), keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*told), F.struct(*told)).alias("edge"))
    both = hits.join(known, keys, "left")
    own = [F.when(F.col("edge").isNotNull(), F.col(f"edge.{c}")).otherwise(F.col(c) if c in hits.columns else F.lit("")).alias(c) for c in told]
    return as_paths(both.select(*keys, *own, "score"), "relationship_vector")


def _once(paths: DataFrame) -> DataFrame:
    """A path once with its best score, in their places: by score, then path."""
    rest = [c for c in paths.columns if c != "path"]
    once = paths.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("score", "source_file", "document_id")).alias("p")).select("path", "p.*")
    return numbered(once, F.desc("score"), "path")


def mixed_paths(entity_hits: DataFrame, relation_hits: DataFrame, edges: DataFrame) -> DataFrame:
    """All paths from entity hits and from relationship hits, each by score, taken in turn; a path once, where it
    comes first. A node may have any number of edges, so places are given in two steps, by range."""
    streams = [_once(rows).withColumn("_stream", F.lit(i)) for i, rows in enumerate((local_paths(entity_hits, edges), global_paths(relation_hits, edges)))]
    every = reduce(DataFrame.unionByName, streams)
    rest = [c for c in every.columns if c != "path"]
    first = every.groupBy("path").agg(F.min_by(F.struct(*rest), F.struct("pos", "_stream")).alias("p")).select("path", "p.*")
    return numbered(first.withColumnRenamed("pos", "_place"), "_place", "_stream").drop("_place", "_stream")


def literal_paths(nodes: DataFrame, edges: DataFrame, question: str, intent: str, terms: list[str]) -> DataFrame:
    """Edges by words: an end that is a node which the question, the intent or a term names, or a term
    in the edge's own text. The nodes may be many, so they are joined, not listed."""
    said = contains_any(F.col("text"), terms)
    named = nodes.where((F.col("id") != "") & (F.contains(F.lit(question), F.col("id")) | (F.col("id") == intent) | said)).select("id").distinct()
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(named.select(F.col("id").alias(end), F.lit(1).alias(f"_{end}")), end, "left")
    text = F.concat_ws(" ", "source", "label", "target", "description", "evidence", "source_file", "document_id")
    ends = F.coalesce("_source", F.lit(0)) + F.coalesce("_target", F.lit(0))
    found = corpus.keyword_count(text, tuple(t for t in terms if t))
    score = F.least(F.lit(1.0), 0.5 * _confidence() + 0.12 * ends + F.least(F.lit(0.32), 0.08 * found))
    return _once(as_paths(rows.where(ends + found > 0).withColumn("score", score), "dynamic_literal"))


def query_keywords(
    question: str,
    intent: str,
    nodes: DataFrame,
    edges: DataFrame,
    hints: list[str],
    aliases: dict[str, tuple[str, ...]],
    places: tuple[tuple[str, ...], str] = ((), ""),
    intents: tuple[str, ...] = (),
    entities: tuple[str, ...] = (),
) -> DataFrame:
    """kind (entity or relationship), pos, keyword, fallback: what a question asks a graph for, each keyword once where it
    comes first.

    Entities: those given that it says, names of the dictionary, the intent if it is a node, nodes that it names by id or
    label, its quoted terms. Relationships: hints that it says, what words for places stand for (``places``: the words, the
    field), an intent that has one of the words ``intents``, labels that it says or that hold a keyword found so far, hints
    that both it and an edge's description say, its words of Latin letters. Nodes go by id and edges by label. A kind without
    any has the question itself, and ``fallback`` says of both that one had none."""
    spark = nodes.sparkSession
    said = [h for h in hints if h in question or h == intent]
    relations = [*said, *([places[1]] if any(w in question for w in places[0]) else []), *([intent] if any(w in intent for w in intents) else [])]
    named = [e for e in entities if e and (e in question or e == intent)]
    named += [name for name, words in aliases.items() if name in question or any(w and w in question for w in words)]
    plain = [("entity", 0, str(i).zfill(6), k) for i, k in enumerate(named)] + [("relationship", 0, str(i).zfill(6), k) for i, k in enumerate(relations)]
    own = spark.createDataFrame(plain, "kind string, step int, at string, keyword string")
    asked = spark.range(1).select(F.lit(question).alias("q"))
    listed = lambda kind, step, words: asked.select(F.posexplode(words).alias("n", "keyword")).select(F.lit(kind).alias("kind"), F.lit(step).alias("step"), F.lpad(F.col("n").cast("string"), 6, F.lit("0")).alias("at"), "keyword")
    quoted = listed("entity", 3, quoted_terms(F.col("q")))
    words = listed("relationship", 3, F.regexp_extract_all("q", F.lit("[A-Za-z0-9][A-Za-z0-9_-]+"), F.lit(0)))
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("id")) if "label" in nodes.columns else F.col("id")
    names = nodes.select("id", label.alias("label")).where(F.col("id") != "")
    inside = lambda c: F.contains(F.lit(question), c)
    is_intent = names.where((F.col("id") == intent) & F.lit(intent != "")).select(F.lit("entity").alias("kind"), F.lit(1).alias("step"), F.col("id").alias("at"), F.col("id").alias("keyword"))
    entity = names.select(F.lit("entity").alias("kind"), F.lit(2).alias("step"), F.col("id").alias("at"), F.when(inside(F.col("id")), F.col("id")).when(inside(F.col("label")), F.col("label")).alias("keyword"))
    labels = edges.select("label").distinct().where((F.col("label") != "") & (inside(F.col("label")) | contains_any(F.col("label"), relations)))
    labels = labels.select(F.lit("relationship").alias("kind"), F.lit(1).alias("step"), F.col("label").alias("at"), F.col("label").alias("keyword"))
    both = [h for h in hints if h in question]
    found = [own, quoted, words, is_intent, entity, labels]
    if both and "description" in edges.columns:
        told = F.coalesce(F.nullif("description", F.lit("")), F.col("evidence"), F.lit(""))
        hit = edges.select(F.explode(F.array_compact(F.array(*[F.when(F.contains(told, F.lit(h)), F.lit(h)) for h in both]))).alias("keyword")).distinct()
        found.append(hit.select(F.lit("relationship").alias("kind"), F.lit(2).alias("step"), F.col("keyword").alias("at"), "keyword"))
    every = reduce(DataFrame.unionByName, found).where("trim(keyword) <> ''").withColumn("keyword", F.trim("keyword"))
    once = every.groupBy("kind", "keyword").agg(F.min(F.struct("step", "at")).alias("first"))
    kinds = spark.createDataFrame([("entity",), ("relationship",)], "kind string")
    rows = kinds.join(once, "kind", "left").select("kind", F.coalesce("keyword", F.lit(question)).alias("keyword"), F.col("keyword").isNull().alias("none"), "first")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("first"))  # as many as a question names
    return rows.select("kind", place.alias("pos"), "keyword", F.max("none").over(Window.partitionBy(F.lit(1))).alias("fallback")).where("keyword <> ''")


def graph_candidates(k: int) -> int:
    """Entity and relationship hits that a graph search asks for."""
    return max(3 * k, 6)


def path_chunks(chunks: DataFrame, paths: DataFrame, category: str, terms: list[str], k: int) -> DataFrame:
    """The k best chunks for paths: a pool by keywords, with 0.65 more for a file of the paths and 0.25 more for a
    text that has a path's evidence or one of its parts, 1 at most. The pool grows with the paths; parts are looked
    for in it all at once."""
    pool = cut(retrieval.keyword_category_search(chunks, category, terms, [], max(4 * k, k + paths.count()), "chunk_id"))
    filed = paths.where("source_file <> ''").select("source_file", F.lit(0.65).alias("_file")).distinct()
    parts = F.filter(F.array_append(F.transform(F.split("path", "->"), lambda x: F.trim(x)), F.col("evidence")), lambda x: x != "")
    told = term_hits(pool, ["chunk_id"], "content", paths.select(F.explode(parts))).select("chunk_id", F.lit(0.25).alias("_said")).distinct()
    more = F.coalesce("_file", F.lit(0.0)) + F.coalesce("_said", F.lit(0.0))
    scored = pool.join(filed, "source_file", "left").join(told, "chunk_id", "left").withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + more), 4))
    return placed(scored.drop("_file", "_said").orderBy(F.desc("score"), "chunk_id").limit(k), F.desc("score"), "chunk_id")


def graph_search(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, entity_hits: DataFrame, relation_hits: DataFrame, question: str, intent: str, terms: list[str], k: int, governed: bool = True, static: DataFrame | None = None) -> Found:
    """Paths by vector hits; where there are none by words; where there are none either, under governance chunks by
    keywords alone, else the static edges (``static``: source, label, target, source_file) around the terms.

    Which way it goes depends on what is found, so paths are computed here, once."""
    paths, source = cut(mixed_paths(entity_hits, relation_hits, edges)), "graph_vector_mix"
    if paths.isEmpty():
        paths, source = cut(literal_paths(nodes, edges, question, intent, terms)), "dynamic_literal"
    if paths.isEmpty():
        by_words = placed(retrieval.keyword_category_search(chunks, intent, terms, [], k, "chunk_id"), F.desc("score"), "chunk_id")
        if governed or static is None:
            return Found(by_words, paths, "governed_text")
        near = corpus.one_hop(static, terms).select("path", "source_file").unionByName(corpus.two_hop(static, terms).withColumn("source_file", F.lit("")))
        once = near.groupBy("path").agg(F.max("source_file").alias("source_file")).orderBy("path").limit(k)
        blank = {c: F.lit("") for c in ("description", "document_id", "evidence")}
        return Found(by_words, placed(once.withColumns(blank | {"score": F.lit(0.0), "match_source": F.lit("static_graph")}), "path"), "static_graph")
    return Found(path_chunks(chunks, paths, intent, terms, k), paths.where(F.col("pos") <= k), source)


# -- tools ------------------------------------------------------------------------------------------------------------


def with_parents(hits: DataFrame, parents: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Hits of child granularity replaced by their parent, which keeps the child's score and names it; the rest as
    they are. A chunk that comes again stands where it came first, with its best score (the earliest of equals).

    Parents that the reader may not see must not be among ``parents``. The hits of one question are few and are sent to
    the parents; those of a table of questions (``scope``: what names one) are joined by their measured size."""
    child = F.col("granularity").isin(*CHILDREN) & F.col("parent_chunk_id").isNotNull()
    wanted = hits.where(child).select("document_id", F.col("parent_chunk_id").alias("chunk_id")).distinct()
    known = parents.join(wanted if scope else F.broadcast(wanted), ["document_id", "chunk_id"], "left_semi")
    known = known.select("document_id", F.col("chunk_id").alias("parent_chunk_id"), F.struct("granularity", "source_file", "content").alias("_p")).dropDuplicates(["document_id", "parent_chunk_id"])
    both = hits.join(known, ["document_id", "parent_chunk_id"], "left").withColumn("_up", child & F.col("_p").isNotNull())
    own = lambda c: F.when(F.col("_up"), F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c)
    rows = both.select(
        *scope,
        "pos",
        F.when(F.col("_up"), F.col("parent_chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        "document_id",
        F.when(~F.col("_up"), F.col("parent_chunk_id")).alias("parent_chunk_id"),
        own("granularity"),
        own("source_file"),
        own("content"),
        "score",
        F.when(F.col("_up"), F.col("chunk_id")).alias("matched_chunk_id"),
        F.when(F.col("_up"), F.col("granularity")).alias("matched_granularity"),
    )
    once = retrieval.exact_dedup(rows, list(scope), "chunk_id", "score", "pos")
    return placed(once.drop("pos"), "first_pos", scope=scope).drop("first_pos")


def _where() -> Column:
    """What a hit's near copies share with it: its document, or its file, or its place, where it has none."""
    return F.coalesce(F.nullif("document_id", F.lit("")), F.nullif("source_file", F.lit("")), F.concat(F.lit("row:"), F.col("pos").cast("string")))


def near_copies_folded(hits: DataFrame, threshold: float = 0.85, scope: tuple[str, ...] = ()) -> DataFrame:
    """Hits of which none nearly repeats an earlier one of its document (or file, or itself, where it has none), for
    each question (``scope``); a place is that of the first of its copies."""
    rows = hits.withColumn("_scope", F.to_json(F.struct(*scope, _where().alias("_where"))))
    kept = retrieval.near_dup_greedy(rows, "_scope", "chunk_id", "content", "score", "pos", threshold)
    payload = rows.drop("pos", "score")
    return kept.select("_scope", "chunk_id", "score", "pos").join(payload, ["_scope", "chunk_id"]).drop("_scope")


def without_near_copies(hits: DataFrame, threshold: float = 0.85, scope: tuple[str, ...] = ()) -> DataFrame:
    """``near_copies_folded``, numbered anew."""
    return placed(near_copies_folded(hits, threshold, scope).withColumnRenamed("pos", "_pos"), "_pos", scope=scope).drop("_pos")


def may_repeat(hits: DataFrame, size: str, threshold: float, scope: tuple[str, ...] = ()) -> Column:
    """Whether a hit has another beside it, of its question and document, that is near enough by size (the number of
    shingles) to be its near copy. The next in size say so for all."""
    beside = Window.partitionBy(*scope, _where()).orderBy(size)
    near = lambda small, large: F.coalesce(small >= threshold * large - 1e-6, F.lit(False))
    return (F.col(size) > 0) & (near(F.lag(size).over(beside), F.col(size)) | near(F.col(size), F.lead(size).over(beside)))


def _finished(hits: DataFrame, parents: DataFrame, k: int, threshold: float) -> DataFrame:
    return without_near_copies(with_parents(hits, parents), threshold).where(F.col("pos") <= k)


def vector_candidates(rows: DataFrame, questions: list[DataFrame], category: str, entities: list[str], files: list[str], k: int, candidates: int, min_score: float = 0.35) -> DataFrame:
    """Hits of one or more question vectors (the question and its expansions), each chunk once with its best score."""
    found = [placed(retrieval.vector_search(rows, q, category, entities, files, k, candidates, min_score, "chunk_id"), F.desc("score"), F.desc("vector_score"), "chunk_id").select("pos", *HIT, F.lit(i).alias("_q")) for i, q in enumerate(questions)]
    every = placed(reduce(DataFrame.unionByName, found).withColumnRenamed("pos", "_at"), "_q", "_at").drop("_q", "_at")
    best = retrieval.exact_dedup(every, [], "chunk_id", "score", "pos").drop("pos")
    return placed(best, F.desc("score"), "first_pos").where(F.col("pos") <= candidates).drop("first_pos")


def vector_tool(hits: DataFrame, parents: DataFrame, k: int, threshold: float = 0.85) -> DataFrame:
    """``vector_candidates`` with parent context, without near copies, the first k."""
    return _finished(hits, parents, k, threshold)


def graph_tool(found: Found, parents: DataFrame, k: int, threshold: float = 0.85) -> Found:
    """What ``graph_search`` found with parent context, without near copies; k chunks and k paths."""
    first = found.chunks.where(F.col("pos") <= k)
    return Found(_finished(first.select("pos", *HIT), parents, k, threshold), found.paths.where(F.col("pos") <= k), found.source)


def hybrid_tool(vector: DataFrame, graph: Found, words: DataFrame, parents: DataFrame, k: int, candidates: int, threshold: float = 0.85) -> Found:
    """The first k of vector and of graph and all keyword hits taken in turn up to ``candidates``, then parent
    context, near copies out, k chunks. Which stream a hit came from isn't kept with a parent."""
    streams = [vector.where(F.col("pos") <= k), graph.chunks.where(F.col("pos") <= k), words]
    merged = retrieval.round_robin([s.select("pos", *HIT) for s in streams], candidates, [], "chunk_id")
    hits = merged.drop("pos", "stream").withColumnRenamed("rank", "pos")
    return Found(_finished(hits, parents, k, threshold), graph.paths.where(F.col("pos") <= k), graph.source)
