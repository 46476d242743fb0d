"""Categories of documents, roll-ups, graph of categories, files and topics, paths and edge scores."""

from __future__ import annotations

from functools import reduce

from fathom.functions.text import file_category, matched_terms, source_topics
from fathom.session import free
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyword_count(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords a text contains."""
    return sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def infer_category(file: Column, text: Column, categories: dict[str, tuple[str, ...]], head: int = 1200) -> Column:
    """The category with most keywords in the file's name and the text's first characters; of equals the first
    by rule order; without any, a category from the name."""
    seen = F.concat(file, F.lit("\n"), F.substring(text, 1, head))
    counts = {name: keyword_count(seen, words) for name, words in categories.items()}
    if not counts:
        return file_category(file)
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    ladder = F.when(best == 0, file_category(file))
    for name, n in counts.items():
        ladder = ladder.when(n == best, name)
    return ladder


def rollup(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """category, document_count, chunk_count, source_files (sorted): two roll-ups joined, so neither multiplies
    the other. Sources are few a category: a set of names, not of documents."""
    a = docs.groupBy("category").agg(F.count("*").alias("document_count"), F.array_sort(F.collect_set("source_file")).alias("source_files"))
    b = chunks.groupBy("category").agg(F.count("*").alias("chunk_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return a.join(b, "category", "full_outer").select("category", zero("document_count"), zero("chunk_count"), "source_files")


def rollup_counted(docs: DataFrame, chunks: Column) -> DataFrame:
    """The same where a document's number of chunks follows from the document: one pass, and no chunk is made to be counted."""
    return docs.groupBy("category").agg(F.count("*").alias("document_count"), F.sum(chunks).cast("long").alias("chunk_count"), F.array_sort(F.collect_set("source_file")).alias("source_files"))


def rollup_by_document(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """category, document_id, source_file, chunk_count, keyword_hits of every document that a category's documents or chunks
    name: what the roll-up says of each, one row a document instead of a map that grows with the corpus. docs: category,
    document_id, source_file, keywords (array); chunks: category, document_id."""
    keep = lambda rows: rows.where(F.coalesce("document_id", F.lit("")) != "")
    a = keep(docs).groupBy("category", "document_id").agg(F.max("source_file").alias("source_file"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keyword_hits"))
    b = keep(chunks).groupBy("category", "document_id").agg(F.count("*").alias("chunk_count"))
    none = F.array().cast("array<string>")
    return a.join(b, ["category", "document_id"], "full_outer").select("category", "document_id", F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), F.coalesce("keyword_hits", none).alias("keyword_hits"))


def memberships(docs: DataFrame, entities: dict[str, tuple[str, ...]], titles: bool = False) -> DataFrame:
    """One row a document and node it speaks of: document_id, source_file, category, topic (null for none). ``titles``: what
    the file's name and the head of its text quote, and its cleaned title, are topics, too."""
    lower = free("_lower", docs)  # a column of its own, so that it is made once and not for each entity
    docs = docs.withColumn(lower, F.lower("content"))
    topic = F.filter(F.array(*[F.when(F.size(matched_terms(F.col(lower), terms)) > 0, F.lit(name)) for name, terms in entities.items()]), lambda x: x.isNotNull())
    if titles:
        topic = F.array_distinct(F.concat(topic, source_topics(F.regexp_replace("source_file", r"\.[^.]*$", ""), F.coalesce("content", F.lit("")))))
    return docs.select("document_id", "source_file", "category", F.explode_outer(topic).alias("topic"))


def graph_nodes(members: DataFrame) -> DataFrame:
    """id, kind, label, documents (count), files (count) of category, file and topic nodes. Nodes met several
    times are one; its sets are united, and counted, not gathered."""
    node = lambda kind: members.where(F.col(kind).isNotNull()).select(F.concat(F.lit(f"{kind}:"), kind).alias("id"), F.lit(kind).alias("kind"), F.col(kind).alias("label"), "document_id", "source_file")
    files = members.withColumnRenamed("source_file", "file").withColumn("source_file", F.col("file"))
    file_nodes = files.select(F.concat(F.lit("file:"), "file").alias("id"), F.lit("file").alias("kind"), F.col("file").alias("label"), "document_id", "source_file")
    every = node("category").unionByName(file_nodes).unionByName(node("topic"))
    return every.groupBy("id").agg(F.first("kind").alias("kind"), F.first("label").alias("label"), F.countDistinct("document_id").alias("documents"), F.countDistinct("source_file").alias("files"))


def graph_edges(members: DataFrame) -> DataFrame:
    """source, label, target, source_file, evidence: category contains file, file mentions topic, category
    relates to topic; evidence counts the documents behind an edge. A membership gives its three edges at once, so that
    what makes memberships runs once."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    category, file, topic = name("category", "category"), name("file", "source_file"), name("topic", "topic")
    edges = [category, F.lit("contains"), file, file, F.lit("mentions"), topic, category, F.lit("relates"), topic]
    every = members.select(F.stack(F.lit(3), *edges).alias("source", "label", "target"), "source_file", "document_id")
    return every.where("target is not null").groupBy("source", "label", "target", "source_file").agg(F.countDistinct("document_id").alias("evidence"))


def one_hop(edges: DataFrame, entities: list[str]) -> DataFrame:
    """Paths of one edge with either end among the entities."""
    found = edges.where(F.col("source").isin(entities) | F.col("target").isin(entities))
    return found.select(F.concat_ws(" -> ", "source", "label", "target").alias("path"), "source_file").dropDuplicates(["path"])


def two_hop(edges: DataFrame, entities: list[str]) -> DataFrame:
    """Paths of two edges that meet, from an entity to an entity; both ends are filtered before the join."""
    a = edges.where(F.col("source").isin(entities)).select("source", F.col("label").alias("first"), F.col("target").alias("middle"))
    b = edges.where(F.col("target").isin(entities)).select(F.col("source").alias("middle"), F.col("label").alias("second"), "target")
    return a.join(b, "middle").select(F.concat_ws(" -> ", "source", "first", "middle", "second", "target").alias("path")).distinct()


def edge_score(terms: list[str], entities: list[str], confidence: Column) -> Column:
    """0.5 of the confidence, 0.12 an end among the entities, 0.08 a term in the edge's text up to 0.32; 0
    without any hit, 1 at most."""
    text = F.concat_ws(" ", "source", "label", "target")
    ends = F.col("source").isin(entities).cast("int") + F.col("target").isin(entities).cast("int")
    found = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = F.least(F.lit(1.0), 0.5 * confidence + 0.12 * ends + F.least(F.lit(0.32), 0.08 * found))
    return F.when(ends + found == 0, 0.0).otherwise(score)


def hit_edges(hits: DataFrame, edges: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Edges with an end among the hits (node, score), scored by the best of hits and confidence, 1 at most.
    Two equi-joins, not one with OR, so both can be hashed."""
    ends = [edges.join(hits, edges[c] == hits["node"]).select(*keys, confidence, "score") for c in ("source", "target")]
    both = reduce(DataFrame.unionByName, ends)
    return both.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.max("score"), F.max(confidence))).alias("score"))


def relation_boost(score: Column, file: Column, content: Column, files: list[str], terms: list[str]) -> Column:
    """0.65 more for a file of the paths, 0.25 more for any of their terms, 1 at most."""
    said = reduce(lambda a, b: a | b, [F.contains(content, F.lit(t)) for t in terms], F.lit(False))
    return F.least(F.lit(1.0), score + 0.65 * file.isin(files).cast("double") + 0.25 * said.cast("double"))


def path_edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """source, label, target of every step of paths a -> label -> b -> label -> c; shorter ones have none."""
    tokens = F.transform(F.split(path, "->"), lambda x: F.trim(x))
    steps = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("source"), F.get(tokens, i + 1).alias("label"), F.get(tokens, i + 2).alias("target"), (i % 2).alias("odd"))), lambda s: (s["odd"] == 0) & s["target"].isNotNull())
    return paths.select(F.explode(steps).alias("s")).select("s.source", "s.label", "s.target").distinct()


def path_entities(paths: DataFrame, path: str = "path") -> DataFrame:
    """The entities (even places) of paths, once each."""
    tokens = paths.select(F.posexplode(F.transform(F.split(path, "->"), lambda x: F.trim(x))).alias("pos", "entity"))
    return tokens.where("pos % 2 = 0").select("entity").distinct()


def entity_matches(text: Column, entities: dict[str, tuple[str, ...]]) -> Column:
    """Names whose alias occurs in the text, in the dictionary's order."""
    names = [F.when(F.size(matched_terms(F.lower(text), aliases)) > 0, F.lit(n)) for n, aliases in entities.items()]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def implied_entities(text: Column, found: Column, rules: list[tuple[tuple[tuple[str, ...], ...], str]]) -> Column:
    """Entities with those that a text implies behind them, each once: a rule has groups of words, of each of which the text
    must have one, and the name that it brings along."""
    more = []
    for groups, name in rules:
        holds = F.lit(True)
        for words in groups:
            holds = holds & (keyword_count(text, words) > 0)
        more.append(F.when(holds, F.lit(name)))
    return F.array_distinct(F.concat(found, F.array_compact(F.array(*more)))) if more else found


def first_of(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The first row of each scope."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where("_n = 1").drop("_n")
