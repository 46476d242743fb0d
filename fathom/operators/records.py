"""Records of a graph's nodes and edges as texts, rules for what a schema and a set of questions may hold, and the context
that an answer is made from.

Rules are data: what a row may have is a list of names and kinds, and one pass gives every row a verdict and a reason, so
that what was left out can be seen."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from fathom.functions import canonical
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


# What stands before the parts of a record's text, what joins files, and the titles of a context's blocks.
ENTITY = ("实体：", "类型：", "分类：", "来源文件：")
RELATION = ("关系：", "描述：", "证据：", "来源文件：")
FILES = "、"
BLOCKS = ("Knowledge Graph Data (Entity)", "Knowledge Graph Data (Relationship)", "Document Chunks", "Reference Document List")


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _lines(titles: tuple[str, ...], *values: Column | str) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(t), v) for t, v in zip(titles, values, strict=True)])


def _strings() -> Column:
    return F.array().cast("array<string>")


def safe(c: Column, kind: T.DataType) -> Column:
    """A value that a vector store takes: texts, numbers and booleans as they are, null as an empty text, anything else as
    JSON. All are texts here but numbers and booleans that can't be null."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.when(c.isNotNull(), canonical.canonical_json(c, kind, compact=False)).otherwise("")
    return _text(c)


# -- graph records ----------------------------------------------------------------------------------------------------


def entity_records(nodes: DataFrame) -> DataFrame:
    """record_id, text, id, label, type, category, source_files, document_id: one row a node (id, label, type, category,
    source_files, document_ids) and document, one without document where a node has none. A node of several documents
    doesn't show its files, as a reader may not see all of them."""
    ids = F.array_sort(F.array_distinct(F.filter(F.coalesce("document_ids", _strings()), lambda x: x.isNotNull() & (x != ""))))
    files = F.filter(F.coalesce("source_files", _strings()), lambda x: x.isNotNull() & (x != ""))
    shown = F.when(F.size(F.coalesce("document_ids", _strings())) <= 1, files).otherwise(_strings())
    each = nodes.select(
        _text("id").alias("id"),
        F.coalesce(F.nullif(F.col("label"), F.lit("")), _text("id")).alias("label"),
        _text("type").alias("type"),
        _text("category").alias("category"),
        shown.alias("source_files"),
        F.explode(F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("")))).alias("document_id"),
    )
    name = F.concat(F.lit("entity::"), "id", F.when(F.col("document_id") != "", F.concat(F.lit("::doc::"), "document_id")).otherwise(""))
    said = _lines(ENTITY, "label", "type", "category", F.array_join("source_files", FILES))
    return each.select(name.alias("record_id"), said.alias("text"), "id", "label", "type", "category", "source_files", "document_id")


def relationship_records(edges: DataFrame) -> DataFrame:
    """record_id, text and an edge's fields: one row an edge (source, label, target, description, evidence, source_file,
    document_id, confidence; null: empty, 0.8)."""
    rows = edges.select(*[_text(c).alias(c) for c in ("source", "label", "target", "description", "evidence", "source_file", "document_id")], F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
    own = F.concat("source", F.lit("->"), "label", F.lit("->"), "target")
    said = _lines(RELATION, F.concat_ws(" ", "source", "label", "target"), "description", "evidence", "source_file")
    return rows.select(F.concat(F.lit("relationship::"), own).alias("record_id"), said.alias("text"), own.alias("id"), *rows.columns)


def category_documents(categories: DataFrame, documents: DataFrame) -> DataFrame:
    """category, document_id, source_file of each category (category, source_files, document_sources: an array of
    document_id and source_file): the documents that it lists, or, where it lists none, those of its files."""
    listed = F.filter(F.coalesce("document_sources", F.array().cast("array<struct<document_id:string,source_file:string>>")), lambda s: F.coalesce(s["source_file"], F.lit("")) != "")
    rows = categories.select("category", "source_files", listed.alias("listed"))
    own = rows.select("category", F.explode("listed").alias("s")).select("category", _text("s.document_id").alias("document_id"), F.col("s.source_file").alias("source_file"))
    files = rows.where(F.size("listed") == 0).select("category", F.explode(F.array_distinct(F.coalesce("source_files", _strings()))).alias("source_file")).where("source_file <> ''")
    return own.unionByName(files.join(documents.select(_text("document_id").alias("document_id"), "source_file"), "source_file").select("category", "document_id", "source_file"))


# -- schema of a graph ------------------------------------------------------------------------------------------------

# Fields that a graph's schema may show, their kinds, and what of a picture may follow which field.
NODE_FIELDS = ("id", "label", "type", "category", "source_files", "evidence_count", "risk_level", "document_count", "chunk_count")
EDGE_FIELDS = ("source", "target", "label", "relation", "description", "evidence", "source_file", "graph_source", "category", "confidence")
FIELD_TYPES = ("string", "number", "list", "boolean")
VISUAL_KEYS = ("node_color_by", "edge_color_by", "node_size_by", "edge_width_by")
DETAIL_MOST = 8


def judged(rows: DataFrame, scope: list[str], order: str, key: Column, checks: dict[str, Column], most: int | None = None) -> DataFrame:
    """Rows with a key, ``kept`` and ``reason``: the first check (by name) that fails; else ``repeated`` where an earlier
    row of the scope has the key and passed; else ``beyond`` where ``most`` rows of the scope were kept before.

    One pass by scope and key, one by scope; a scope is one schema or set of questions."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()], F.lit(""))
    told = rows.withColumn("key", key).withColumn("reason", failed)
    passed = F.col("reason") == ""
    first = Window.partitionBy(*scope, "key", "reason").orderBy(order)
    once = told.withColumn("_n", F.row_number().over(first)).withColumn("reason", F.when(passed & (F.col("_n") > 1), "repeated").otherwise(F.col("reason"))).drop("_n")
    if most is not None:
        before = F.count_if(F.col("reason") == "").over(Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        once = once.withColumn("_n", before).withColumn("reason", F.when((F.col("reason") == "") & (F.col("_n") > most), "beyond").otherwise(F.col("reason"))).drop("_n")
    return once.withColumn("kept", F.col("reason") == "")


def schema_fields(fields: DataFrame, scope: list[str]) -> DataFrame:
    """Fields of schemas (scope, kind: node or edge, position, key, label, type), judged: known keys of their kind, the
    first of each. label: the key where there is none, 32 characters at most; type: string where it is none of the known."""
    key, names = F.trim(_text("key")), F.when(F.col("kind") == "node", F.array(*map(F.lit, NODE_FIELDS))).when(F.col("kind") == "edge", F.array(*map(F.lit, EDGE_FIELDS))).otherwise(_strings())
    found = judged(fields, [*scope, "kind"], "position", key, {"unknown": F.array_contains(names, key)})
    label, kind = F.coalesce(F.nullif("label", F.lit("")), F.col("key")), F.trim(F.coalesce(F.nullif("type", F.lit("")), F.lit("string")))
    return found.withColumns({"label": F.substring(F.trim(label), 1, 32), "type": F.when(kind.isin(*FIELD_TYPES), kind).otherwise("string")})


def schema_details(details: DataFrame, fields: DataFrame, scope: list[str]) -> DataFrame:
    """Fields shown in detail (scope, kind, position, key), judged: kept fields of the schema (``schema_fields``), each
    once, ``DETAIL_MOST`` of a kind at most."""
    known = fields.where("kept").select(*scope, "kind", "key", F.lit(True).alias("_known"))
    rows = details.join(known, [*scope, "kind", "key"], "left")
    return judged(rows, [*scope, "kind"], "position", F.col("key"), {"unknown": F.col("_known")}, DETAIL_MOST).drop("_known")


def schema_visuals(mappings: DataFrame, scope: list[str]) -> DataFrame:
    """What a picture follows (scope, position, key, value), judged: known keys with known fields; of one key the last
    counts, as in an object."""
    known = F.col("value").isin(*NODE_FIELDS, *EDGE_FIELDS)
    last = mappings.withColumn("_back", -F.col("position"))
    return judged(last, scope, "_back", F.col("key"), {"unknown key": F.col("key").isin(*VISUAL_KEYS), "unknown field": known}).drop("_back")


def projected(rows: DataFrame, fields: Iterable[tuple[str, str]]) -> DataFrame:
    """The configured fields (name, type) of rows: those that rows lack have their type's empty value."""
    empty = {"string": F.lit(""), "number": F.lit(0.0), "boolean": F.lit(False), "list": _strings()}
    return rows.select(*[F.col(name) if name in rows.columns else empty.get(kind, F.lit("")).alias(name) for name, kind in fields if name])


# -- questions --------------------------------------------------------------------------------------------------------

MOST_QUESTIONS, LEAST_QUESTIONS, MOST_COMMON, LEAST_COMMON = 14, 8, 10, 5


def closest_category(category: Column, categories: Column) -> Column:
    """The category itself if it is one; else the first that contains it or is contained in it; else the first."""
    near = F.filter(categories, lambda c: F.contains(c, category) | F.contains(category, c))
    return F.when(F.array_contains(categories, category), category).otherwise(F.coalesce(F.get(near, F.lit(0)), F.get(categories, F.lit(0)), F.lit("")))


def generated_questions(raw: DataFrame, scope: list[str], categories: list[str], defaults: tuple[str, ...] = ()) -> DataFrame:
    """Questions that were made up (scope, position, id, question, category), judged: not blank, the first of each, at most
    ``MOST_QUESTIONS``; a category that isn't known becomes the closest one that is, a missing id one by position."""
    question, known = F.trim(_text("question")), F.array(*map(F.lit, categories)) if categories else _strings()
    found = judged(raw, scope, "position", question, {"blank": question != ""}, MOST_QUESTIONS)
    said = F.trim(_text("category"))
    named = F.when(said.isin(*categories, *defaults), said).otherwise(closest_category(said, known)) if categories or defaults else closest_category(said, known)
    return found.withColumns({"question": F.col("key"), "category": named, "id": F.coalesce(F.nullif(F.trim(_text("id")), F.lit("")), F.concat(F.lit("llm_q_"), F.col("position").cast("string")))}).drop("key")


def common_questions(categories: DataFrame, templates: dict[str, str], otherwise: str, defaults: tuple[str, ...]) -> DataFrame:
    """position, question: one a category (name, position) by its template, or by ``otherwise`` with its name for {}; while
    there are less than five those of ``defaults``; each once, ten at most."""
    spark = categories.sparkSession
    listed = spark.createDataFrame(list(templates.items()) or [("", "")], "name string, template string")
    own = categories.where("name <> ''").join(F.broadcast(listed), "name", "left").select("position", F.trim(F.coalesce("template", F.replace(F.lit(otherwise), F.lit("{}"), F.col("name")))).alias("question"))
    own = own.groupBy("question").agg(F.min("position").alias("position")).withColumn("part", F.lit(0))
    more = spark.createDataFrame(list(enumerate(defaults)), "position int, question string").select(F.col("position").cast("long").alias("position"), F.trim("question").alias("question"), F.lit(1).alias("part"))
    every = own.select(F.col("position").cast("long").alias("position"), "question", "part").unionByName(more.join(own.select("question"), "question", "left_anti").select("position", "question", "part")).where("question <> ''")
    place = F.row_number().over(Window.orderBy("part", "position"))  # of a list of categories, and of it the first ten
    return every.withColumn("n", place).where((F.col("n") <= MOST_COMMON) & ((F.col("part") == 0) | (F.col("n") <= LEAST_COMMON))).select(F.col("n").alias("position"), "question")


@dataclass(frozen=True)
class Question:
    """A question that is asked where none was made up: its intent is its category unless it says another."""

    id: str
    question: str
    category: str
    kind: str
    modes: tuple[str, ...]
    paths: bool = False
    references: bool = True
    intent: str = ""
    sources: tuple[str, ...] = ()  # categories whose files are expected


def fallback_questions(categories: DataFrame, templates: dict[str, Question], otherwise: Question, more: list[Question], defaults: tuple[str, ...]) -> DataFrame:
    """position and the fields of questions that stand in for made-up ones: one for each of the first seven categories
    (position, name, source_files) by its template, or ``otherwise`` with the name for {}; then ``more`` (about relations, a
    follow-up, one that nothing answers); then those of ``defaults`` while there are less than eight. A question once, 14 at
    most. Categories are a list; its first seven are taken by place, and files are looked up for the named ones alone."""
    spark = categories.sparkSession
    kind = "part int, position long, name string, id string, question string, category string, kind string, modes array<string>, paths boolean, references boolean, intent string, sources array<string>"
    row = lambda part, i, q, name: (part, i, name, q.id.replace("{}", name), q.question.replace("{}", name), q.category.replace("{}", name), q.kind, list(q.modes), q.paths, q.references, q.intent or q.category.replace("{}", name), [x.replace("{}", name) for x in q.sources])
    first = categories.where("name <> ''").orderBy("position").limit(7).select("name").collect()  # seven at most
    rows = [row(0, i, templates.get(r["name"], otherwise), r["name"]) for i, r in enumerate(first)] + [row(1, i, q, "") for i, q in enumerate(more)]
    have = len(rows)
    rows += [row(2, i, templates.get(name, otherwise), name) for i, name in enumerate(defaults[: max(0, LEAST_QUESTIONS - have)])]
    table = spark.createDataFrame(rows, kind)
    wanted = table.select("part", "position", F.posexplode("sources").alias("at", "of"))
    files = wanted.join(categories.select(F.col("name").alias("of"), "source_files"), "of").groupBy("part", "position").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("source_files", _strings()).alias("f")))), lambda x: x["f"])).alias("expected_sources"))
    every = table.drop("sources").join(files, ["part", "position"], "left").withColumn("expected_sources", F.coalesce("expected_sources", _strings()))
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("part", "position"))).where("n = 1")
    place = F.row_number().over(Window.orderBy("part", "position"))  # a list of some twenty
    return once.withColumn("n", place).where(F.col("n") <= MOST_QUESTIONS).drop("part", "position", "name").withColumnRenamed("n", "position")


def fallback_name(categories: DataFrame, rules: list[tuple[tuple[str, ...], bool, str]], otherwise: str) -> DataFrame:
    """name: of a knowledge base by the first rule that holds: words of which one is a category (True) or is in one."""
    out = F.lit(otherwise)
    for words, whole, name in reversed(rules):
        hit = F.col("name").isin(*words) if whole else F.col("name").rlike("|".join(f"\\Q{w}\\E" for w in words))
        out = F.when(F.coalesce(F.bool_or(hit), F.lit(False)), name).otherwise(out)
    return categories.agg(out.alias("name"))


def schema_summary(categories: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the first 12 categories (position, name, document_count, chunk_count, source_files) with 8 files each, the
    files of the first 16 documents (position, source_file), the titles of the first 24 chunks (position, section_title), and
    how many chunks there are. Each list is a top-k, so nothing else moves."""
    first = lambda rows, n, c: rows.orderBy("position").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", c.alias("v")))), lambda x: x["v"]).alias("list"))
    one = F.struct("name", "document_count", "chunk_count", F.slice("source_files", 1, 8).alias("source_files"))
    parts = [first(categories, 12, one).select(F.col("list").alias("categories")), first(documents, 16, F.col("source_file")).select(F.col("list").alias("source_files")), first(chunks, 24, F.col("section_title")).select(F.col("list").alias("section_titles")), chunks.agg(F.count("*").alias("chunk_count"))]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("one", F.lit(1))), "one")
    return out.drop("one")


# -- context ----------------------------------------------------------------------------------------------------------


def _block(title: str, rows: Column, kind: T.DataType) -> Column:
    """A list of objects as JSON with two spaces a level, keys as they are, under its title."""
    fields = kind.elementType.fields
    line = lambda x: F.array_join(F.array(*[F.concat(F.lit(f'    "{f.name}": '), canonical.canonical_json(x[f.name], f.dataType)) for f in fields]), ",\n")
    listed = F.when(F.size(rows) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(rows, lambda x: F.concat(F.lit("  {\n"), line(x), F.lit("\n  }"))), ",\n"), F.lit("\n]")))
    return F.concat(F.lit(f"{title}:\n\n```json\n"), listed, F.lit("\n```\n\n"))


def answer_context(chunks: DataFrame, paths: DataFrame, questions: DataFrame, scope: list[str]) -> DataFrame:
    """scope, context: the text that a question's answer is made from: the entities of its relation paths (pos, path,
    description, source_file, evidence, score, match_source), the paths, its chunks (pos, source_file, section_title, category,
    content) and the list of their files, as four blocks. Budgets have cut both before, so a question's are few."""
    order = lambda rows, fields: rows.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("list"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("pos")).alias("reference_id")
    said = order(chunks.withColumn("pos", F.col("pos").cast("long")).select(*scope, "pos", place, *[_text(c).alias(c) for c in ("source_file", "section_title", "category", "content")]), ["reference_id", "source_file", "section_title", "category", "content"]).withColumnRenamed("list", "chunks")
    told = order(paths.select(*scope, F.col("pos").cast("long").alias("pos"), *[_text(c).alias(c) for c in ("path", "description", "source_file", "evidence")], F.col("score"), _text("match_source").alias("match_source")), ["path", "description", "source_file", "evidence", "score", "match_source"]).withColumnRenamed("list", "paths")
    parts = F.filter(F.transform(F.split("path", "->"), lambda x: F.trim(x)), lambda x: x != "")
    steps = paths.select(*scope, F.col("pos").cast("long").alias("pos"), F.posexplode(F.filter(parts, lambda x, i: i % 2 == 0)).alias("at", "id"))
    once = steps.groupBy(*scope, "id").agg(F.min(F.struct("pos", "at")).alias("m")).select(*scope, "id", F.col("id").alias("label"), F.col("m.pos").alias("pos"), F.col("m.at").alias("at"))
    entities = once.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", F.struct("id", "label").alias("r")))), lambda x: x["r"]).alias("entities"))
    rows = questions.select(*scope).distinct().join(said, scope, "left").join(told, scope, "left").join(entities, scope, "left")
    filled = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    blocks = [_block(title, filled(c), rows.schema[c].dataType) for title, c in zip(BLOCKS, ("entities", "paths", "chunks"))]
    files = F.array_join(F.transform(filled("chunks"), lambda x: F.concat(F.lit("["), x["reference_id"].cast("string"), F.lit("] "), F.coalesce(F.nullif(x["source_file"], F.lit("")), F.lit("unknown")))), "\n")
    return rows.select(*scope, F.concat(*blocks, F.lit(f"{BLOCKS[-1]}:\n\n```\n"), files, F.lit("\n```\n")).alias("context"))
