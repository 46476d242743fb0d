"""N-gram Jaccard join: a size-aware join of sets of word shingles, light sets by subsets, heavy by lists.

Two sets that link share much of their *prefixes*, the shingles that come first in one order of all shingles
(rare before frequent). Small sets put every pair of prefix shingles up as a key (subsets of fixed size two, in
a prefix longer by one); large sets are scanned through the inverted lists of single prefix shingles. The size
that parts them is the one with the least expected cost.

A group of near copies isn't turned into pairs. Within each list all are compared with one pivot; those that
link stand behind it, at a known distance. As one minus Jaccard is a metric, two pivots further apart than the
threshold and both distances have no link between those behind them; only for pivots in between are the sets
behind them compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, extended
from .shared import forget, only, task, unused, with_classes, written
from .tokens import portions


@dataclass(frozen=True)
class Settings:
    """Sets of ``words``-word shingles link when 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85
    frequent: int = 16  # shingles in more sets than this come last in the order
    max_frequent: int = 1_000_000  # so many of them at most are sent to the workers; the limit above rises to fit
    list_block: int = 128  # pivots of a list that are paired at once
    check_cost: float = 4.0  # cost of a candidate, in keys
    broadcast_rows: int = 500_000


_HASHES: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes. A-Z are lowered and words end at ASCII
    white space, which is what ``bytes`` methods do; fewer words than a shingle has form one."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.array([], np.uint64)
    known = _HASHES
    if len(known) > 100_000:
        known.clear()
    hashes = []
    for w in split:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 48:
                known[w] = h
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    width = min(words, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * _M1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def prefix_size(n: int, percent: int) -> int:
    """Sets of n shingles that link with another share one of the first so many: n minus the least overlap, plus one."""
    return n - -(-percent * n // 100) + 1


def parities(sorted_set: np.ndarray) -> bytes:
    """For each cell of the hash space, whether the set has an odd number in it, as bits: about two cells a
    shingle. The cells in which two sets differ are at most as many as the shingles in which they do."""
    bits = max(8, int(2 * max(1, len(sorted_set)) - 1).bit_length())
    cells = (sorted_set & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=1 << bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch(sorted_set: np.ndarray) -> list[int]:
    """Parities over 512 cells as eight 64-bit integers, for comparing without leaving the JVM."""
    cells = (sorted_set & np.uint64(511)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def differing_cells(a: bytes, b: bytes) -> int:
    """Least number of shingles in one of two sets alone, from their parities; the longer is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _frequent(docs: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many texts, sorted, and in how many: each task counts over its own rows and reports what it
    saw twice; the sums above the limit count as frequent. Any choice of them gives the same links; a good one
    keeps lists short. The list is bounded by max_frequent."""

    @task
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[twice].view(np.int64)), pa.array(counts[twice].astype(np.int64))], ["h", "n"])

        only("shingles", _HASHES)
        held, size = [], 0
        for batch in batches:
            for rows in portions(batch, 0):
                for text in rows.column(0).to_pylist():
                    held.append(shingles(text, s.words))
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield counted(held)
                        held, size = [], 0
        if held:
            yield counted(held)

    seen = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > s.frequent)
    seen, limit = written(seen, "frequent"), s.frequent
    while seen.where(F.col("n") > limit).count() > s.max_frequent:
        limit *= 2
    rows = seen.where(F.col("n") > limit).toPandas()
    order = np.argsort(rows["h"].to_numpy().view(np.uint64))
    return rows["h"].to_numpy().view(np.uint64)[order], rows["n"].to_numpy()[order]


def _sets(docs: DataFrame, s: Settings, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, n, digest, prefix (in order, longer by one for subsets), parities and sketch of each document's set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles", _HASHES)
        common, counts = sent.value
        for batch in batches:
            for rows in portions(batch, 1):
                out: list[list] = [[], [], [], [], []]
                for text in rows.column(1).to_pylist():
                    found = shingles(text, s.words)
                    take = prefix_size(len(found), s.percent) + 1
                    if len(common):
                        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        rank = np.where(common[at] == found, counts[at], 0)
                        prefix = found[np.argsort(rank, kind="stable")[:take]]
                    else:
                        prefix = found[:take]
                    out[0].append(len(found))
                    out[1].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    out[2].append(prefix.view(np.int64))
                    out[3].append(parities(found))
                    out[4].append(sketch(found))
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *[pa.array(x, k) for x, k in zip(out, kinds)]], ["id", "text_hash", "n", "digest", "prefix", "parities", "sketch"])

    return docs.select("id", "text", "text_hash").mapInArrow(run, "id long, text_hash long, n long, digest binary, prefix array<long>, parities binary, sketch array<long>")


def _boundary(sets: DataFrame, s: Settings) -> int:
    """Largest set size for which subsets cost less than lists: keys, and candidates by the mean list length."""
    sizes = sets.groupBy("n").count().collect()  # one row for each size of a set, not for each set
    lists = sets.select(F.explode(F.slice("prefix", 1, 2)).alias("h")).groupBy("h").count()
    total, squares = lists.agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    others = (squares or 0) / (total or 1) - 1
    best, at = 0.0, 0
    gain = 0.0
    for n, rows in sorted((r["n"], r["count"]) for r in sizes):
        p = prefix_size(n, s.percent)
        gain += rows * (p * (1 + s.check_cost * others) - p * (p + 1) / 2)
        if gain > best:
            best, at = gain, n
    return at


def _keys(sets: DataFrame, boundary: int, s: Settings) -> DataFrame:
    """cid, n, key, pos: keys under which sets are met. pos is the place in the prefix, -1 for a subset."""
    p = (F.col("n") - F.ceil(F.col("n") * s.percent / 100.0) + 1).cast("int")
    heavy = sets.where(F.col("n") > boundary).select("cid", "n", F.posexplode(F.slice("prefix", F.lit(1), p)).alias("pos", "key"))
    light = sets.where(F.col("n") <= F.lit(boundary * 100 // s.percent))
    pair = lambda x, i: F.transform(F.slice("prefix", i + 2, p + 1), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))
    light = light.select("cid", "n", F.lit(-1).alias("pos"), F.explode(F.flatten(F.transform(F.slice("prefix", F.lit(1), p + 1), pair))).alias("key"))
    return heavy.select("cid", "n", "key", "pos").unionByName(light.select("cid", "n", "key", "pos"))


def _near(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs a, b, reach that sizes and parities don't rule out. reach: the largest distance of interest."""
    own = sets.select("cid", "n", "parities")
    both = pairs.join(own.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("parities").alias("pa")), "a")
    both = both.join(own.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("parities").alias("pb")), "b")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, reach, na, x, nb, y = (batch.column(i) for i in range(7))
            size = (na.to_numpy() + nb.to_numpy()).astype(np.float64)
            apart = np.array([differing_cells(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], np.float64)
            # d >= 1 - (size - apart) / (size + apart) = 2 * apart / (size + apart)
            kept = pa.array(2 * apart / (size + apart) <= reach.to_numpy() + 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in (a, b, reach)], ["a", "b", "reach"])

    return both.select("a", "b", "reach", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long, reach double")


def _within(p: Column, q: Column, reach: Column) -> Column:
    """Whether sizes and sketches of two sets (n, sketch) leave room for a distance up to reach. With x shingles
    in one set alone the distance is 2 x / (n + m + x)."""
    apart = F.aggregate(F.zip_with(p["sketch"], q["sketch"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x)
    sized = F.least(p["n"], q["n"]) >= (1 - reach) * F.greatest(p["n"], q["n"]) - 1e-6
    return sized & ((2 - reach) * apart <= reach * (p["n"] + q["n"]) + 1e-6)


def _measured(pairs: DataFrame, sets: DataFrame, docs: DataFrame, s: Settings, name: str) -> DataFrame:
    """Exact intersection and union of pairs a, b (with reach): the sets are made again from the whole texts of
    the documents concerned alone."""
    pairs = near = written(_near(pairs, sets, s), f"{name}-near")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    keys = written(sets.join(wanted, "cid", "left_semi").select("cid", "id", "text_hash"), f"{name}-wanted")
    small = keys.count() <= s.broadcast_rows
    texts = docs.join(F.broadcast(keys) if small else keys, docs["id"].eqNullSafe(keys["id"]) & (docs["text_hash"] == keys["text_hash"]))
    texts = texts.select("cid", "text")

    @task
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles", _HASHES)
        seen: set[int] = set()  # copies of a text have one set; what is left is dropped below
        for batch in batches:
            for rows in portions(batch, 1):
                cids, kept, found = rows.column(0).to_pylist(), [], []
                for cid, text in zip(cids, rows.column(1).to_pylist()):
                    if cid not in seen:
                        if len(seen) < 200_000:
                            seen.add(cid)
                        kept.append(cid)
                        found.append(shingles(text, s.words).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(found, pa.binary())], ["cid", "members"])

    members = written(texts.mapInArrow(make, "cid long, members binary").dropDuplicates(["cid"]), f"{name}-members")
    both = pairs.join(members.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, union = [], []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared.append(len(np.intersect1d(x, y, assume_unique=True)))
                union.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "reach", "shared", "joined"])

    out = written(both.select("a", "b", "reach", "x", "y").mapInArrow(run, "a long, b long, reach double, shared long, joined long"), name)
    forget(near, keys, members)
    return out


def _links(measured: DataFrame, s: Settings) -> Column:
    return F.col("shared") * 100 >= F.col("joined") * s.percent


def _crossed(parted: DataFrame, stand: DataFrame, sets: DataFrame, reach: float) -> DataFrame:
    """Candidates among the sets behind two pivots (a, b, between: how far apart the pivots are): all pairs of
    sets, one behind each, that can be within reach.

    A pivot can itself stand behind another one; what is compared is always the pivot's own set, as the radius
    is about it and the set needn't be among those behind."""
    own = sets.select(F.col("cid").alias("leader"), F.struct("n", "sketch").alias("sb"))
    heads = stand.groupBy("leader").agg(F.max("d").alias("rb")).join(own, "leader").withColumnRenamed("leader", "b")
    pairs = written(parted.select("a", "b", "between").join(heads, "b"), "parted")
    left = stand.select(F.col("leader").alias("a"), F.col("cid").alias("x"), F.col("d").alias("dx"), F.col("set").alias("sx"))
    right = stand.select(F.col("leader").alias("b"), F.col("cid").alias("y"), F.col("d").alias("dy"), F.col("set").alias("sy"))
    some = (pairs["a"] == left["a"]) & (pairs["between"] - left["dx"] - pairs["rb"] <= reach + 1e-9) & _within(left["sx"], pairs["sb"], F.lit(reach) + pairs["rb"])
    half = pairs.join(left, some).select("b", "between", "x", "dx", "sx")
    toward = (half["b"] == right["b"]) & (half["between"] - half["dx"] - right["dy"] <= reach + 1e-9) & _within(half["sx"], right["sy"], F.lit(reach))
    return half.join(right, toward).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(reach).alias("reach")).distinct()


def _grouped(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, text_hash, n, group, name of each document with words (group: the same for all that are reachable by
    links; name: its smallest id), and id of each without."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    reach = 1 - s.percent / 100
    every = written(_sets(docs, s, _frequent(docs.select("text"), s)), "sets")
    fewest = next(n for n in range(1, 10_000) if 100 * n >= s.percent * (n + 1))  # smaller sets link with equal ones alone
    sets = every.where(F.col("n") >= fewest).dropDuplicates(["digest"]).withColumn("cid", F.monotonically_increasing_id())
    sets = written(sets, "distinct-sets")
    keys = _keys(sets, _boundary(sets, s), s)
    # Lists: their first set is the pivot of all. Keys of one set alone go.
    pivots = keys.groupBy("key").agg(F.min("cid").alias("pivot"), F.count("*").alias("listed")).where("listed > 1")
    lists = written(keys.join(pivots, "key").select("key", "cid", "n", "pos", "pivot"), "lists")
    sized = sets.select(F.col("cid").alias("pivot"), F.col("n").alias("pivot_n"))
    stars = lists.where("cid <> pivot").select("cid", "n", "pivot").distinct().join(sized, "pivot")
    stars = stars.where(F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * s.percent)
    first = _measured(stars.select(F.col("pivot").alias("a"), F.col("cid").alias("b"), F.lit(reach).alias("reach")), sets, docs, s, "stars")
    linked = first.where(_links(first, s)).select("a", "b", (1 - F.col("shared") / F.col("joined")).alias("d"))
    # A set stands behind the first pivot that it links with; radius: how far off those behind a pivot are.
    behind = written(linked.groupBy("b").agg(F.min(F.struct("a", "d")).alias("m")).select(F.col("b").alias("cid"), F.col("m.a").alias("leader"), F.col("m.d").alias("d")), "behind")
    nodes = written(components(linked.select("a", "b")), "joined")
    joined = nodes.select(F.col("node").alias("cid"), "component")
    placed = lists.select("key", "cid", "n", "pos").join(behind, "cid", "left").join(joined, "cid", "left")
    placed = placed.select("key", "cid", "n", "pos", F.coalesce("leader", "cid").alias("leader"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "cid").alias("component"))
    own = sets.select(F.col("cid").alias("leader"), F.col("n").alias("leader_n"), "sketch")
    heads = placed.groupBy("key", "leader", "component").agg(F.max("d").alias("radius"), F.min("pos").alias("pos"), F.count("*").alias("members"))
    apart = heads.groupBy("key").agg(F.count("*").alias("heads"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "heads")
    blocks = heads.join(apart, "key").join(own, "leader").withColumn("block", F.pmod(F.xxhash64("leader"), F.ceil(F.col("heads") / s.list_block)))
    one = F.struct("leader", "component", "radius", F.col("leader_n").alias("n"), F.when((F.col("members") == 1) & (F.col("radius") == 0), F.col("pos")).otherwise(-1).alias("pos"), "sketch")
    last = F.ceil(F.first("heads") / s.list_block).cast("long") - 1
    blocks = written(blocks.groupBy("key", "block").agg(last.alias("last"), F.sort_array(F.collect_list(one)).alias("heads")), "heads")
    # Each pair of blocks of a list is a key of its own, so a long list isn't one task's.
    x = blocks.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.col("heads").alias("xs"))
    y = blocks.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("heads").alias("ys"))
    far = lambda p, q: F.lit(reach) + p["radius"] + q["radius"]
    # Shingles before the first shared place are in one set alone; pos is known for sets that stand for themselves.
    early = lambda p, q: (p["pos"] < 0) | (q["pos"] < 0) | ((2 - reach) * (p["pos"] + q["pos"]) <= reach * (p["n"] + q["n"]) * 1.0000001)
    close = lambda p, q: (p["component"] != q["component"]) & early(p, q) & _within(p, q, far(p, q))
    made = lambda p: F.transform(
        F.filter("ys", lambda q: ((F.col("i") < F.col("j")) | (p["leader"] < q["leader"])) & close(p, q)),
        lambda q: F.struct(F.least(p["leader"], q["leader"]).alias("a"), F.greatest(p["leader"], q["leader"]).alias("b"), far(p, q).alias("reach")),
    )
    pairs = x.join(y, ["key", "i", "j"]).select(F.explode(F.flatten(F.transform("xs", made))).alias("p")).select("p.*")
    pairs = pairs.groupBy("a", "b").agg(F.max("reach").alias("reach"))
    second = _measured(pairs, sets, docs, s, "pivots")
    between = second.where(_links(second, s)).select("a", "b")
    # Pivots too far apart to link, but not for those behind them: compare these, where they share a list.
    between_d = (1 - F.col("shared") / F.col("joined")).alias("between")
    wide = second.where(~_links(second, s) & (1 - F.col("shared") / F.col("joined") <= F.col("reach") + 1e-9) & (F.col("reach") > reach + 1e-9)).select("a", "b", between_d)
    found = extended(nodes, between)
    if not wide.isEmpty():
        # Those behind a pivot are joined with it, so pivots joined by now leave nothing to find. For the others,
        # a set behind one must lie towards the other pivot and all behind it, then towards the single set.
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}"))
        parted = wide.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b"))
        stand = sets.select("cid", F.struct("n", "sketch").alias("set")).join(behind, "cid", "left")
        stand = written(stand.select("cid", F.coalesce("leader", "cid").alias("leader"), F.coalesce("d", F.lit(0.0)).alias("d"), "set"), "stand")
        crossed = _crossed(parted, stand, sets, reach)
        third = _measured(crossed, sets, docs, s, "behind-pivots")
        found = extended(found, third.where(_links(third, s)))
    found = found.select(F.col("node").alias("cid"), "component")
    # Names: the smallest id of a set's documents, then of a component's sets.
    named = every.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"))
    classes = written(named.join(sets.select("digest", "cid"), "digest", "left").join(found, "cid", "left"), "classes")
    least = classes.where("component is not null").groupBy("component").agg(F.min("least").alias("of_component"))
    grouped = with_classes(classes.where("component is not null"), least, "component").unionByName(classes.where("component is null").withColumn("of_component", F.lit(None).cast("long")))
    group = F.coalesce(F.coalesce("component", "cid").cast("string"), F.hex("digest"))
    named = written(grouped.select("digest", group.alias("group"), F.coalesce("of_component", "least").alias("name")), "names")
    with_words = with_classes(every.where("digest is not null").select("id", "text_hash", "n", "digest"), named, "digest")
    return with_words.select("id", "text_hash", "n", "group", F.coalesce("name", "id").alias("name")), every.where("digest is null").select("id")


def cluster(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Documents without words have no shingles and are in no component but their own; so are nulls. Equal sets,
    repeated rows among them, link. Rows with a null id stay and take part, but name a component only where
    no other id does. An empty table gives no rows; other columns aren't read. Links are exact: no cap on
    lists, candidates or groups. Sets are told apart by 64-bit hashes of shingles and a 128-bit digest.
    """
    linked, alone = _grouped(docs, settings, id_col, text_col)
    out = linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
    return out.unionByName(alone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with its columns as they were: the one with the smallest id (a null id
    only where no other is), of those the one with the smallest hash of the text, of equal rows any one.

    Null and empty texts and those without words belong to no component and stay, row by row. Rows with a null
    or repeated id are judged by their own texts. A caller's columns may have any names; an empty table gives no
    rows. Texts move only where the kept keys are too many to broadcast, and for keys that repeat."""
    linked, _ = _grouped(docs, settings, id_col, text_col)
    best = linked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("m"))
    key, digest = unused("id", docs), unused("hash", docs)
    kept = best.select(F.col("m.id").alias("id"), F.col("m.text_hash").alias("text_hash")).distinct()
    times = linked.groupBy("id", "text_hash").agg((F.count("*") > 1).alias("again"))
    same = kept["id"].eqNullSafe(times["id"]) & (kept["text_hash"] == times["text_hash"])
    kept = written(kept.join(times, same).select(kept["id"].alias(key), kept["text_hash"].alias(digest), "again"), "kept")
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    of = lambda k: F.col(id_col).cast("long").eqNullSafe(k[key]) & (F.xxhash64(text_col) == k[digest])
    once, again = kept.where("not again"), kept.where("again")
    out = docs.where(~has_words).unionByName(docs.where(has_words).join(once, of(once), "left_semi"))
    if again.isEmpty():
        return out
    repeated = docs.where(has_words).join(again, of(again))
    return out.unionByName(repeated.dropDuplicates([key, digest]).select(*[docs[f"`{c}`"] for c in docs.columns]))
