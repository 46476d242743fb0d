"""Many terms at once: which of any number of terms the texts of a table contain.

The terms make up an Aho-Corasick automaton, which finds all of them in one walk over a text. It is sent to the tasks in
shards of a measured size, by a hash of the term, so that no task holds more than a shard however many terms there are;
texts are read once a shard."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from fathom.functions.text import source_topics
from fathom.session import cut
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a node of the automaton takes, about one a byte of a term.
NODE = 40
#: The automaton that a worker has built last.
_BUILT: dict[str, object] = {}


def _automaton(token: str, terms: pa.Array):
    if token not in _BUILT:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, t in enumerate(terms.to_pylist()):
            found.add_word(t, (i, len(t)))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[token] = found
    return _BUILT[token]


def _bordered(term: str) -> bool:
    """Whether two occurrences of a term can overlap: it begins as it ends."""
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


def _by_number(token: str, terms: list[str]):
    if f"numbers-{token}" not in _BUILT:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            found.add_word(t, i)
        found.make_automaton()
        _BUILT.clear()
        _BUILT[f"numbers-{token}"] = found, np.array([_bordered(t) for t in terms]), {i for i, t in enumerate(terms) if _bordered(t)}
    return _BUILT[f"numbers-{token}"]


def found_in(text: str, token: str, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the terms in a text, and how often each occurs as ``counted`` says, as arrays."""
    if not terms:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton, bordered, _ = _by_number(token, terms)
    number, n = np.unique(np.array([i for _, i in automaton.iter(text)], np.int64), return_counts=True)
    for at in np.flatnonzero(bordered[number] & (n > 1)).tolist():
        n[at] = text.count(terms[number[at]])  # from left to right, without overlaps
    return number, n


def hits_in(text: str, token: str, terms: list[str]) -> list[int]:
    """The same for a short text as a list, each term as often as it occurs."""
    if not terms:
        return []
    automaton, _, bordered = _by_number(token, terms)
    hits = [i for _, i in automaton.iter(text)]
    if len(hits) > 1 and not bordered.isdisjoint(hits):
        return [i for i in set(hits) for _ in range(text.count(terms[i]))]
    return hits


def counted(text: str, automaton) -> dict[int, int]:
    """Terms (by number) in a text and how often each occurs from left to right without overlapping itself."""
    n: dict[int, int] = {}
    free_from: dict[int, int] = {}
    for end, (i, size) in automaton.iter(text):
        if end - size + 1 >= free_from.get(i, 0):
            n[i] = n.get(i, 0) + 1
            free_from[i] = end + 1
    return n


def _portions(texts: pa.Array, automaton) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """Texts in portions of some 50,000 hits: the place of the first, how many terms each has, their numbers and counts."""
    first, each, found, n = 0, [], [], []
    for i, x in enumerate(texts):
        hits = counted(x.as_py() or "", automaton)
        each.append(len(hits))
        found += hits.keys()
        n += hits.values()
        if len(found) >= 50_000 or i + 1 == len(texts):
            yield first, each, found, n
            first, each, found, n = i + 1, [], [], []


def shards(terms: DataFrame, most_bytes: int) -> list[Broadcast]:
    """Distinct terms, not empty, in tables whose automata have about so many bytes at most, with what else stands beside
    a term."""
    more = terms.columns[1:]
    said = cut(terms.select(F.col(terms.columns[0]).cast("string").alias("t"), *more).where("t <> ''").distinct().toDF("t", *[f"m{i}" for i in range(len(more))]))
    beside = F.octet_length(F.to_json(F.struct(*said.columns[1:]))) if more else F.lit(0)
    n = max(1, -(-(said.agg(F.sum(F.octet_length("t") * NODE + beside)).first()[0] or 0) // most_bytes))
    out = []
    for i in range(n):
        some = said.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i).toArrow().sort_by("t").combine_chunks()
        if some.num_rows:
            out.append(terms.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, some)))
    return out


def term_hits(rows: DataFrame, keys: list[str], text: str, terms: DataFrame, term: str = "term", count: str = "n", most_bytes: int = 256 << 20, listed: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """keys, term, n: one row a text and term that it contains, with the number of occurrences.

    The first column of ``terms`` has the terms; empty terms, null terms and null texts meet nothing, a term that repeats
    counts once. Further columns, the same wherever a term repeats, come with its hits. Case and white space are as they
    are. Rows with the same keys are texts of their own. No shuffle.

    ``listed``: one row a text instead, also for texts without hits, with arrays by name, which are made of the text's
    array of hits (term, n and the further columns) where the text is. Of terms in several shards a text has arrays of
    each, which a shuffle puts together in any order."""
    hit = T.StructType([T.StructField(term, T.StringType()), T.StructField(count, T.LongType()), *terms.schema.fields[1:]])
    plain, sent = rows.select(*keys, text), shards(terms, most_bytes)
    apart = bool(listed) and len(sent) > 1
    if apart:  # by numbers that stay as they are for all shards
        plain = cut(plain.select(F.monotonically_increasing_id(), *plain.columns))
    names = [f"c{i}" for i in range(len(plain.columns) - 1)]
    plain = plain.toDF(*names, "text")
    own = plain.drop("text").schema.fields
    schema = T.StructType([*own, T.StructField("hits", T.ArrayType(hit))] if listed else [*own, *hit.fields])
    lists = [make(F.col("hits")).alias(f"l{i}") for i, make in enumerate((listed or {}).values())]
    out = None
    for one in sent:

        def run(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            token, known = one.value
            automaton = _automaton(token, known.column(0).combine_chunks())
            for batch in batches:
                for first, each, found, n in _portions(batch.column(len(names)), automaton):
                    told, *more = (c.combine_chunks() for c in known.take(pa.array(found, pa.int64())).columns)
                    columns = [told, pa.array(n, pa.int64()), *more]
                    if listed:
                        ends = np.cumsum([0, *each])
                        columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, hit.names))]
                        taken = batch.slice(first, len(each))
                    else:
                        taken = batch.take(pa.array(np.repeat(np.arange(first, first + len(each)), each)))
                    yield pa.RecordBatch.from_arrays([*taken.columns[: len(names)], *columns], schema.names)

        some = plain.mapInArrow(run, schema)
        some = some.select(*names, *lists) if listed else some
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = plain.withColumn("hits", F.array().cast(T.ArrayType(hit))).select(*names, *lists) if listed else rows.sparkSession.createDataFrame([], schema)
    if apart:
        out = out.groupBy("c0").agg(*[F.first(c) for c in names[1:]], *[F.flatten(F.collect_list(f"l{i}")) for i in range(len(lists))]).drop("c0")
    return out.toDF(*keys, *(listed or hit.names))


def knowledge_terms(texts: DataFrame, keys: list[str], text: str, categories: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """keys, files, terms of each text: what of the knowledge base it names (categories: source_file, keywords).

    A term is a keyword of a file or a topic of its name that the text contains; a file is named if the text has its
    name or one of its topics. Both are sorted, once each; a text that names nothing has empty arrays. Terms go to the
    texts with what they stand for, so a text's hits are never dealt by term or gathered by text."""
    files = categories.select("source_file").where("source_file <> ''").distinct()
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    topics = files.select(F.explode(source_topics(stem, F.lit(""))).alias("term"), F.lit(True).alias("said"), "source_file")
    names = files.select(F.col("source_file").alias("term"), F.lit(False).alias("said"), "source_file")
    keywords = categories.select(F.explode("keywords").alias("term"), F.lit(True).alias("said"), F.lit(None).cast("string").alias("source_file"))
    known = topics.unionByName(names).unionByName(keywords).groupBy("term").agg(F.max("said").alias("said"), F.collect_set("source_file").alias("files"))
    lists = {
        "files": lambda hits: F.array_distinct(F.flatten(F.transform(hits, lambda h: h["files"]))),
        "terms": lambda hits: F.transform(F.filter(hits, lambda h: h["said"]), lambda h: h["term"]),
    }
    found = term_hits(texts, keys, text, known, most_bytes=most_bytes, listed=lists)
    return found.select(*keys, F.array_sort(F.array_distinct("files")).alias("files"), F.array_sort("terms").alias("terms"))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether a text has one of a few terms; without terms none has."""
    out = F.lit(False)
    for t in filter(None, terms):
        out = out | F.contains(text, F.lit(t))
    return out
