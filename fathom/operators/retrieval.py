"""Scoring, top-k, fusion, de-duplication, parent context and context budgets."""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from fathom.functions.text import count_of, hashed_shingles, mixed, token_estimate, truncated
from fathom.functions.vectors import cosine
from fathom.session import cut, free, numbered, small_batches
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Up to so many rows a top-k is one limit, whose rows one task holds; more are numbered part by part.
MOST_LIMIT = 10_000


def entity_score(text: Column, entities: list[str]) -> Column:
    """Share of the entities that a text contains."""
    if not entities:
        return F.lit(0.0)
    return F.least(F.lit(1.0), sum(F.coalesce(F.contains(text, F.lit(e)), F.lit(False)).cast("double") for e in entities) / len(entities))


def vector_search(
    rows: DataFrame, query: DataFrame, category: str, entities: list[str], files: list[str], top_k: int = 2, candidate_k: int = 8, min_score: float = 0.35, id_col: str = "doc_id"
) -> DataFrame:
    """The nearest candidates of one query vector (a table of one row, column ``query``), rescored.

    Score: 0.65 of the vector's, 0.20 for the category, 0.10 for entities, 0.05 for the file. Both limits are
    top-k operations: each task keeps its own best and no rows are sorted whole."""
    near = rows.join(F.broadcast(query)).withColumn("vector_score", F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("query")))).drop("query", "embedding")
    near = near.orderBy(F.desc("vector_score"), id_col).limit(max(candidate_k, top_k))
    score = 0.65 * F.col("vector_score") + 0.20 * (F.col("category") == category).cast("double") + 0.10 * entity_score(F.col("content"), entities) + 0.05 * F.col("source_file").isin(files).cast("double")
    return near.withColumn("score", score).where(F.col("score") >= min_score).orderBy(F.desc("score"), F.desc("vector_score"), id_col).limit(candidate_k)


def keyword_category_search(rows: DataFrame, category: str, terms: list[str], files: list[str], k: int, id_col: str) -> DataFrame:
    """0.45, plus 0.2 for the category, 0.08 a term up to 0.3, and 0.05 for the file; the best k."""
    found = sum((F.contains(F.col("content"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = 0.45 + 0.2 * (F.col("category") == category).cast("double") + F.least(F.lit(0.3), 0.08 * found) + 0.05 * F.col("source_file").isin(files).cast("double")
    scored = rows.withColumn("score", score)
    if k <= MOST_LIMIT:
        return scored.orderBy(F.desc("score"), id_col).limit(k)
    place = free("_place", scored)
    return numbered(scored, F.desc("score"), id_col, out=place).where(F.col(place) <= k).drop(place)


def term_frequency_search(rows: DataFrame, terms: list[str], k: int, id_col: str, content: str = "content") -> DataFrame:
    """Rows that contain a term, by min(1, 0.35 + 0.08 for each occurrence); the best k."""
    hits = sum((count_of(F.col(content), F.lit(t)) for t in terms), F.lit(0).cast("long"))
    scored = rows.withColumn("hits", hits).where("hits > 0").withColumn("score", F.least(F.lit(1.0), 0.35 + 0.08 * F.col("hits")))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def stable_identity(chunk_id: Column, document: Column, granularity: Column, chunk_hash: Column, file: Column, content: Column) -> Column:
    """The chunk id; else a hash of document, granularity and chunk hash; else of file and content."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.when(document.isNotNull() & chunk_hash.isNotNull(), F.sha2(F.concat_ws("|", document, granularity, chunk_hash), 256)), F.sha2(F.concat_ws("|", file, content), 256))


def exact_dedup(hits: DataFrame, scope: list[str], identity: str, score: str, pos: str) -> DataFrame:
    """One row an identity: at the place where it came first, with the payload of its best score (the earliest
    of equals)."""
    same, n = Window.partitionBy(*scope, identity), free("_n", hits)
    ranked = hits.withColumn("first_pos", F.min(pos).over(same)).withColumn(n, F.row_number().over(same.orderBy(F.desc(score), pos)))
    return ranked.where(F.col(n) == 1).drop(n)


def round_robin(streams: list[DataFrame], k: int, scope: list[str], identity: str, pos: str = "pos") -> DataFrame:
    """Streams interleaved by place, in the order given, without what was seen; k rows a scope.

    An identity stands where it comes first by (place, stream)."""
    every = None
    for i, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(i))
        every = s if every is None else every.unionByName(s)
    first = Window.partitionBy(*scope, identity).orderBy(pos, "stream")
    kept = every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(pos, "stream"))).where(F.col("rank") <= k)


#: Hashes that go on at once; a larger set goes alone.
PORTION = 250_000

#: Bytes of texts or sets that a worker gets at once; Spark's own bound, 64 MB, is held several times by every task.
BATCH_BYTES = 4 << 20


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], np.int64), *sets])))


def _sets(docs: DataFrame, scope: str, id_col: str, content: str) -> DataFrame:
    """scope, id, s: the shingles of each row, as sorted hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sets, size = 0, [], 0
            for i, text in enumerate(batch.column(2)):
                sets.append(hashed_shingles(text.as_py()))
                size += len(sets[-1])
                if size > PORTION or i + 1 == batch.num_rows:
                    own = batch.slice(start, len(sets))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _lists(sets)], [scope, "id", "s"])
                    start, sets, size = i + 1, [], 0

    given = docs.select(F.col(scope), F.col(id_col).alias("id"), F.col(content).alias("_text"))
    return given.mapInArrow(hashed, StructType([*given.schema.fields[:2], StructField("s", ArrayType(LongType()))]))


class Pieces:
    """Keys of sets that reach a similarity: sizes lie in intervals so wide that the larger of two sets is in the interval of
    the smaller or in the next. For each interval hashes are dealt into more pieces than two such sets can have differences,
    so that some pieces are equal; a key stands for a piece with all that is in it. Of so many equal ones the weakest needn't
    have keys (few pairs of words, then few trigrams, come often), as any two sets put their common pieces in one order."""

    def __init__(self, threshold: float):
        self.t, self.bounds = threshold, [1]

    def interval(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, math.ceil(self.bounds[-1] / self.t)))
        return bisect_right(self.bounds, n) - 1

    def dealt(self, i: int) -> tuple[int, int, int]:
        """Of an interval: pieces, those that have keys, and how many keys two sets share at least."""
        most = self.bounds[i + 1] - 1
        differences = math.floor((1 - self.t) / (1 + self.t) * (most + math.floor(most / self.t + 1e-6)) + 1e-6)
        equal = 2 + differences // 5
        shared = 1 + equal // 8
        return differences + equal, differences + shared if differences else 0, shared

    def keys(self, grams: np.ndarray, i: int) -> np.ndarray:
        (n, kept, _), s = self.dealt(i), grams.view(np.uint64)
        piece = ((s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        inside, pairs = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        inside[piece[starts]], pairs[piece[starts]] = np.add.reduceat(mixed([s], 3), starts), np.add.reduceat(s & np.uint64(1), starts)
        keys = mixed([np.arange(n, dtype=np.uint64), inside], i + 1 << 32)
        return keys[np.lexsort((keys, np.bincount(piece, minlength=n), pairs))[n - kept :]].view(np.int64)


#: Texts that the rarity of shingles is counted in, at most (about), and cells of the count.
RARITY_ROWS, RARITY_BITS = 4_096, 23

#: Parts that shingles are dealt into by their hashes, which are counted.
DEALT = 192

#: Classes with candidates that are sent to the texts.
MOST_SENT = 500_000

#: Classes whose sets a cell of comparisons has from either side, about.
CELL = 256


def _rarity(docs: DataFrame, scope: str, id_col: str, content: str) -> np.ndarray:
    """How often shingles come in a bounded sample of texts, by the first bits of their hashes, 255 at most. It only says in which
    order a set's shingles become keys, so no result depends on the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << RARITY_BITS, np.uint8)
        for batch in batches:
            cell, n = np.unique(batch.column(2).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - RARITY_BITS), return_counts=True)
            found[cell] = np.minimum(found[cell] + n, 255)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(found, 1)])], ["n"])

    some = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-docs.count() // RARITY_ROWS)))) == 0
    out = np.zeros(1 << RARITY_BITS, np.uint8)
    with small_batches(docs.sparkSession, BATCH_BYTES):
        parts = _sets(docs.where(some), scope, id_col, content).mapInArrow(count, "n binary").collect()
    for (part,) in parts:
        x = np.frombuffer(zlib.decompress(part), np.uint8)
        out = np.where(out > 255 - x, np.uint8(255), out + x)
    return out


def shared_keys(n: int) -> int:
    """How many keys a set of so many shingles has in common with one that is near, if that has as many at least."""
    return 1 + (n >= 20) + (n >= 60)


def rare_keys(grams: np.ndarray, rarity: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a set, as many as leave so few that a near set must have some of them: of two such sets the
    first ``shared_keys`` of all that they have in common are keys of both, whatever the order, as long as it is one."""
    s, n = grams.view(np.uint64), len(grams)
    most = n - math.ceil(threshold * n - 1e-9) + shared_keys(n)
    rank = rarity[s >> np.uint64(64 - RARITY_BITS)].astype(np.uint64) << np.uint64(56) | s & np.uint64((1 << 56) - 1)
    return s[np.argpartition(rank, most - 1)[:most]] if most < n else s


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(grams), digest_size=16).digest()


def _keyed(docs: DataFrame, scope: str, id_col: str, content: str, threshold: float) -> DataFrame:
    """scope, id, c (what equal sets have in common), n, keys and dealt of each row: the number of its shingles, the rarest of them
    as numbers of 32 bits, which differ by scope, and how many fall into each of ``DEALT`` parts (from -128). Without shingles or
    scope c is null. The sets themselves aren't kept."""
    sent = docs.sparkSession.sparkContext.broadcast(_rarity(docs, scope, id_col, content))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys, dealt = [], [], [], []
            for name, s in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                grams = s.values.to_numpy()
                known = len(grams) > 0 and name is not None
                digests.append(_digest(grams) if known else None)
                sizes.append(len(grams))
                apart = np.uint64(int.from_bytes(hashlib.blake2b(repr(name).encode(), digest_size=8).digest(), "little"))
                keys.append((mixed([rare_keys(grams, sent.value, threshold), apart], 7) >> np.uint64(32)).astype(np.uint32).view(np.int32) if known else np.array([], np.int32))
                dealt.append((np.minimum(np.bincount((grams.view(np.uint64) >> np.uint64(40)).astype(np.int64) % DEALT, minlength=DEALT), 255) - 128).astype(np.int8) if known else np.array([], np.int8))
            ends, parts = (np.cumsum([0, *map(len, x)], dtype=np.int32) for x in (keys, dealt))
            counts = pa.ListArray.from_arrays(pa.array(parts), pa.array(np.concatenate([np.array([], np.int8), *dealt])))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], np.int32), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists, counts], names)

    sets = _sets(docs, scope, id_col, content)
    schema = StructType([*sets.schema.fields[:2], StructField("c", BinaryType()), StructField("n", IntegerType()), StructField("keys", ArrayType(IntegerType())), StructField("dealt", ArrayType(ByteType()))])
    names = schema.names
    return sets.mapInArrow(keyed, schema)


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """k1, k2: classes (k, n, keys, dealt) of near sizes that have as many keys in common as near sets have and differ by no more
    than those can in ``dealt``, each pair once."""
    keys = lambda i: classes.select(F.col("k").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.explode("keys").alias("g"))
    least = F.least("n1", "n2")
    some = (F.col("k1") < F.col("k2")) & (least >= threshold * F.greatest("n1", "n2") - 1e-6)
    shared = 1 + (least >= 20).cast("int") + (least >= 60).cast("int")
    common = keys(1).join(keys(2), "g").where(some).select("k1", "k2", shared.alias("shared"))
    pairs = common.groupBy("k1", "k2").agg(F.count("*").alias("_n"), F.min("shared").alias("shared")).where("_n >= shared").select("k1", "k2")
    # Sets that only have a passage in common differ by more, part by part, than near ones can.
    side = lambda i: classes.select(F.col("k").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.col("dealt").alias(f"d{i}"))
    apart = F.aggregate(F.zip_with("d1", "d2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda total, x: total + x)
    both = cut(pairs).join(side(1), "k1").join(side(2), "k2")
    return both.where(apart <= (1 - threshold) / (1 + threshold) * (F.col("n1") + F.col("n2")) + 1e-6).select("k1", "k2")


def _compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """k1, k2, similarity of the pairs that reach the threshold. texts: k, c, content.

    Pairs go into cells by the least class that the first of them is paired with; a group of many classes is dealt into cells
    of about ``CELL`` classes by as many. A text goes once to each cell, not once to each pair, and is hashed there."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("k1").alias("k"), F.col("k1").alias("other")), F.struct(F.col("k2").alias("k"), F.col("k1").alias("other")))).alias("e")).select("e.*")
    lead = ends.groupBy("k").agg(F.min("other").alias("lead"))
    deals = lead.groupBy("lead").agg(F.ceil(F.count("*") / CELL).alias("_deals"))
    led = pairs.join(lead.withColumnRenamed("k", "k1"), "k1").join(deals, "lead")
    dealt = lambda c: F.pmod(F.xxhash64(c), F.col("_deals")).cast("string")
    cells = led.select("k1", "k2", F.concat_ws("/", F.col("lead").cast("string"), dealt("k1"), dealt("k2")).alias("cell"))
    none = F.lit(None).cast("long")
    sides = cells.select("cell", F.explode(F.array(F.struct(F.col("k1").alias("k"), F.col("k2").alias("other")), F.struct(F.col("k2").alias("k"), none.alias("other")))).alias("e"))
    asked = sides.select("cell", "e.*").groupBy("cell", "k").agg(F.collect_list("other").alias("others"))
    rows = asked.join(texts, "k").select("cell", F.struct("k", "c", "others").alias("id"), "content")
    dealt_out = _sets(rows.repartition("cell").sortWithinPartitions("cell"), "cell", "id", "content")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, others = None, {}, {}

        def near() -> Iterator[pa.RecordBatch]:
            found = []
            for k, ks in others.items():
                for j in ks:
                    shared = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    similar = shared / (len(sets[k]) + len(sets[j]) - shared)
                    if similar >= threshold:
                        found.append((k, j, similar))
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[at : at + 10_000], strict=True)], ["k1", "k2", "similarity"])

        for batch in batches:
            for cell, row, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if cell != now:
                    yield from near()
                    now, sets, others = cell, {}, {}
                grams = s.values.to_numpy()
                if _digest(grams) == row["c"]:  # another text may have the same id
                    sets[row["k"]], others[row["k"]] = grams.copy(), row["others"]
        yield from near()

    return dealt_out.mapInArrow(compare, "k1 long, k2 long, similarity double")


def _near_classes(docs: DataFrame, scope: str, id_col: str, content: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """scope, id, class_id (the least id with an equal set of shingles; its own without shingles or scope) and copies of all
    rows, and scope, id1, id2, similarity of classes that reach the threshold, each pair once.

    A text's set becomes a digest and a few keys, its rarest shingles (``rare_keys``), which other texts hardly ever have. Only
    texts that may be near another are read again and compared; copies are compared once, as one class."""
    rows = cut(_keyed(docs, scope, id_col, content, threshold), BATCH_BYTES)
    found = rows.where("c is not null")
    one = found.groupBy(scope, "c").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("dealt").alias("dealt"))
    classes = cut(one.withColumn("k", F.monotonically_increasing_id()))
    members = found.select(scope, "id", "c").join(classes.select(scope, "c", F.col("id").alias("class_id"), "copies"), [scope, "c"]).drop("c")
    alone = rows.where("c is null").select(scope, "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    pairs = cut(_candidates(classes, threshold))
    named = classes.select("k", "c", scope, "id")
    some = cut(named.join(pairs.select(F.explode(F.array("k1", "k2")).alias("k")).distinct(), "k", "left_semi"))
    # So that other texts aren't shuffled, the classes are sent to them where their measured number allows it.
    sent = F.broadcast(some) if some.count() <= MOST_SENT else some
    texts = docs.select(scope, F.col(id_col).alias("id"), F.col(content).alias("content")).join(sent, [scope, "id"]).select("k", "c", "content")
    near = cut(_compared(pairs, texts, threshold), BATCH_BYTES)
    first = near.join(named.select(F.col("k").alias("k1"), scope, F.col("id").alias("a")), "k1")
    both = first.join(named.select(F.col("k").alias("k2"), F.col("id").alias("b")), "k2")
    return members.unionByName(alone), both.select(scope, F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "similarity")


def near_dup_pairs(docs: DataFrame, scope: str, id_col: str, content: str, threshold: float = 0.85) -> DataFrame:
    """Pairs within a scope whose shingles reach the threshold. The result has a row for every pair of copies;
    ``near_dup_classes`` says as much in a row a document."""
    rows, near = _near_classes(docs, scope, id_col, content, threshold)
    members = [rows.select(scope, F.col("class_id").alias(f"c{i}"), F.col("id").alias(f"id{i}")) for i in "12"]
    across = near.withColumnsRenamed({"id1": "c1", "id2": "c2"}).join(members[0], [scope, "c1"]).join(members[1], [scope, "c2"])
    inside = members[0].join(members[1].withColumnRenamed("c2", "c1"), [scope, "c1"]).where("id1 < id2").withColumn("similarity", F.lit(1.0))
    named = lambda df: df.select(scope, F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "similarity")
    return named(across).unionByName(named(inside))


def near_dup_classes(docs: DataFrame, scope: str, id_col: str, content: str, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """scope, id, class_id (the smallest id with an equal set of shingles; its own without shingles) and copies of every
    document, and scope, a, b, similarity of classes that nearly repeat each other, by their class_id. Any number of copies is
    one row a document, not a row a pair."""
    members, near = _near_classes(docs, scope, id_col, content, threshold)
    links = near.select(scope, F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "similarity")
    return members.withColumnRenamed("id", id_col), links


def near_dup_greedy(hits: DataFrame, scope: str, id_col: str, content: str, score: str, pos: str, threshold: float = 0.85) -> DataFrame:
    """Hits of each scope in order, each absorbed by the first kept one that it nearly repeats; a better score
    takes the place over, payload and shingles. The order decides, so a scope, such as a document, is folded
    in one task each; it holds one set of hashes for each hit that it keeps, and compares a hit with those alone that share
    one of their first hashes with it. Texts are dealt by scope and hashed where they are folded, one scope after the other."""

    def first(grams: np.ndarray) -> list[int]:
        """The least hashes of a set, of which two sets that reach the threshold share one."""
        return grams[: len(grams) - math.ceil(threshold * len(grams) - 1e-9) + 1].tolist()

    def put(kept: list[list], index: dict[int, set[int]], place, item, score, text: str | None) -> None:
        grams = hashed_shingles(text)
        own = first(grams)
        for i in sorted({k for g in own for k in index.get(g, ())}):
            other = kept[i][3]
            shared = len(np.intersect1d(grams, other, assume_unique=True))
            if shared >= threshold * (len(grams) + len(other) - shared):
                if score is not None and kept[i][2] is not None and score > kept[i][2]:
                    for g in kept[i][4]:
                        index[g].discard(i)
                    kept[i][1:] = [item, score, grams, own]
                    for g in own:
                        index.setdefault(g, set()).add(i)
                return
        for g in own:
            index.setdefault(g, set()).add(len(kept))
        kept.append([place, item, score, grams, own])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, index, now, out, n = [], {}, None, None, 0

        def close() -> None:
            for place, item, score, *_ in kept:
                for values, x in zip(out, (now, place, item, score), strict=True):
                    values.append(x)

        for batch in batches:
            out = [[] for _ in range(4)]
            scopes, places, items, scores = (batch.column(i).to_pylist() for i in range(4))
            for i, text in enumerate(batch.column(4)):
                if n == 0 or scopes[i] != now:
                    close()
                    kept, index, now = [], {}, scopes[i]
                n += 1
                put(kept, index, places[i], items[i], scores[i], text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, batch.schema, strict=False)], names)
            kinds = list(batch.schema)[:4]
        if n:
            out = [[] for _ in range(4)]
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], names)

    rows = hits.select(F.col(scope).alias("scope"), F.col(pos).alias("place"), F.col(id_col).alias("item"), F.col(score).alias("score"), F.col(content).alias("text"))
    names = ["scope", "place", "item", "score"]
    dealt = rows.repartition("scope").sortWithinPartitions("scope", F.asc_nulls_last("place"), F.asc_nulls_last("item"))
    return dealt.mapInArrow(fold, rows.drop("text").schema).toDF(scope, pos, id_col, score)


def parent_context(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (document_id, parent_chunk_id, chunk_id, score, content, granularity) replaced by their parent,
    which keeps the child's score and names it; a child without parent stays. One row a chunk, best score."""
    p = parents.select("document_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content"))
    both = children.join(p, ["document_id", "parent_chunk_id"], "left")
    found = F.col("parent_content").isNotNull()
    rows = both.select(
        "document_id",
        F.when(found, F.col("parent_chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.coalesce("parent_content", "content").alias("content"),
        "score",
        F.when(found, F.col("chunk_id")).alias("matched_chunk_id"),
        F.when(found, F.col("granularity")).alias("matched_granularity"),
    )
    best = Window.partitionBy("document_id", "chunk_id").orderBy(F.desc("score"), F.col("matched_chunk_id"))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _amount(budget: int | Column) -> Column:
    return budget if isinstance(budget, Column) else F.lit(budget)


def budget_prefix(hits: DataFrame, scope: list[str], pos: str, cost: Column, budget: int | Column, least: int = 12) -> DataFrame:
    """The first rows of each scope whose costs together stay within the budget (of the scope: a number, or a column that
    is the same for all its rows). As a row costs ``least`` at least, no more than budget / least rows can be in it; only
    these are gathered and added up."""
    place = free("_rank", hits)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(pos))
    first = hits.withColumn("cost", cost).withColumn(place, rank).where(F.col(place) <= F.greatest(F.lit(1), F.floor(_amount(budget) / least)))
    running = F.sum("cost").over(Window.partitionBy(*scope).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", running).where(F.col("used") <= _amount(budget)).drop(place)


def _first(rows: DataFrame, scope: list[str], pos: str) -> DataFrame:
    place = free("_rank", rows)
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*scope).orderBy(pos))).where(F.col(place) <= 1).drop(place)


def fit_chunks(hits: DataFrame, scope: list[str], pos: str, budget: int | Column, content: str = "content") -> DataFrame:
    """Hits within a context budget, each with its cost (tokens and 16) and the sum so far (used). A first hit beyond
    the budget is cut to fit, if more than 20 tokens are there; what doesn't fit later ends the list."""
    most = _amount(budget)
    kept = budget_prefix(hits, scope, pos, chunk_cost(F.col(content)), budget, 16).withColumn("truncated", F.lit(False))
    over = _first(hits, scope, pos).where((chunk_cost(F.col(content)) > most) & (most > 20))
    over = over.withColumn(content, truncated(F.col(content), F.greatest(F.lit(1), most - 16))).withColumn("cost", chunk_cost(F.col(content)))
    return kept.unionByName(over.withColumns({"used": F.col("cost"), "truncated": F.lit(True)}))


def fit_relations(paths: DataFrame, scope: list[str], pos: str, budget: int | Column) -> DataFrame:
    """The same for relation paths (path, description, evidence): of a first one beyond the budget the description,
    or else the evidence, is cut to what the path leaves."""
    cost, most = relation_cost(F.col("path"), F.col("description"), F.col("evidence")), _amount(budget)
    kept = budget_prefix(paths, scope, pos, cost, budget, 12).withColumn("truncated", F.lit(False))
    over = _first(paths, scope, pos).where((cost > most) & (most > 20))
    left = F.greatest(F.lit(1), most - token_estimate(F.col("path")) - 12)
    described = F.length("description") > 0
    shorter = {c: F.when(use, truncated(F.col(c), left)).otherwise(F.col(c)) for c, use in (("description", described), ("evidence", ~described))}
    over = over.withColumns(shorter).withColumn("cost", cost)
    return kept.unionByName(over.withColumns({"used": F.col("cost"), "truncated": F.lit(True)}))


def in_context(questions: DataFrame, chunks: DataFrame, paths: DataFrame, max_tokens: int, scope: list[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Chunks and relation paths of each question (scope, question) that its context has room for. Relations may take a
    quarter of the tokens, or what the question leaves; chunks have what both leave."""
    most = max(100, max_tokens)
    fixed = questions.select(*scope, (token_estimate(F.coalesce("question", F.lit(""))) + 100).alias("_fixed")).dropDuplicates(scope)
    for_paths = F.greatest(F.lit(40), F.least(F.lit(int(most * 0.25)), F.lit(most) - F.col("_fixed")))
    told = fit_relations(paths.join(fixed, scope), scope, pos, for_paths)
    used = told.groupBy(*scope).agg(F.max("used").alias("_told"))
    for_chunks = F.greatest(F.lit(60), F.lit(most) - F.col("_fixed") - F.coalesce("_told", F.lit(0)))
    said = fit_chunks(chunks.join(fixed.join(used, scope, "left"), scope), scope, pos, for_chunks)
    return said.drop("_fixed", "_told"), told.drop("_fixed")


EVIDENCE_KEYS = ("content", "source_file", "source_path", "section_title", "category", "score", "rerank_score", "retrieval_channel", "document_id", "chunk_id", "granularity", "matched_chunk_id", "matched_granularity")
_NEVER_NULL = ("content", "source_file", "source_path", "section_title", "category", "retrieval_channel")


def evidence(hits: DataFrame, *also: str) -> DataFrame:
    """Hits projected to the named keys (and others asked for): keys that a hit lacks are null, texts are empty
    instead of null."""
    kinds = {"score": "double", "rerank_score": "double"}
    found = {k: F.col(k) if k in hits.columns else F.lit(None).cast(kinds.get(k, "string")) for k in EVIDENCE_KEYS}
    return hits.select(*also, *[(F.coalesce(c, F.lit("")) if k in _NEVER_NULL else c).alias(k) for k, c in found.items()])


def chunk_cost(content: Column) -> Column:
    return token_estimate(content) + 16


def relation_cost(path: Column, description: Column, evidence: Column) -> Column:
    return token_estimate(path) + token_estimate(description) + token_estimate(evidence) + 12


def budget_split(question: Column, max_tokens: int, used_by_relations: Column) -> tuple[Column, Column]:
    """Token budgets of relations and of chunks."""
    most = max(100, max_tokens)
    fixed = token_estimate(question) + 100
    relations = F.greatest(F.lit(40), F.least(F.lit(int(0.25 * most)), most - fixed))
    return relations, F.greatest(F.lit(60), most - fixed - used_by_relations)


def dynamic_top_k(question: Column, base: int, clauses, requirements) -> Column:
    """base, plus one for 36 characters, two clause signals and three requirement signals; two more and ten in
    all at most."""
    n = lambda terms: sum(count_of(F.lower(question), F.lit(t)) for t in terms)
    more = (F.length(question) >= 36).cast("int") + (n(clauses) >= 2).cast("int") + (n(requirements) >= 3).cast("int")
    return F.least(F.lit(10), base + F.least(F.lit(2), more)).cast("long")
