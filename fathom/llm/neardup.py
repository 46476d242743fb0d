"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits vectors near the middle of a random projection, again and again; those close to a split go to
both sides, so that a close pair is seldom parted, and several trees make up for what one parts. Vectors are
compared within leaves in double precision and united.

Pairs aren't listed. A pair counts in the first tree in which it shares a leaf, which both vectors' leaves tell,
so a leaf reports one row a vector: its number of links there and one vector that it is joined with. A dense
group, most of whose pairs link, stays one leaf; those of its vectors within half of the limiting angle of its
centre all link with each other (triangle inequality) and count so without being compared.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .shared import with_classes, written


@dataclass(frozen=True)
class Settings:
    """spill: half the width of the band around a split that goes to both sides, in standard deviations of the
    projected difference of a pair at the threshold; band: largest share of a node's rows in it.
    block: vectors of a large leaf that meet others at once; sample_rows and sample_bytes bound the vectors that the splits of one leaf are fitted on; all are routed."""

    threshold: float = 0.95
    trees: int = 6
    leaf: int = 512
    spill: float = 0.5
    band: float = 0.15
    sample_rows: int = 20_000
    sample_bytes: int = 32 << 20
    least_sample: int = 32
    seed: int = 17
    broadcast_bytes: int = 64 << 20
    block: int = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """Nodes by number: children (-1: a leaf), cut and margin of the projection, level, and for leaves whether
    they are done with and which centre (by number, -1: none) they have, being dense."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cut: np.ndarray
    margin: np.ndarray
    level: np.ndarray
    done: np.ndarray
    centre: np.ndarray
    centres: np.ndarray


def _dense(x: np.ndarray, threshold: float) -> bool:
    """Whether most pairs of a few rows, taken evenly, link."""
    some = x[np.linspace(0, len(x) - 1, min(len(x), 64)).astype(int)]
    n = len(some)
    return n > 1 and (some @ some.T >= threshold).sum() - n >= 0.5 * n * (n - 1)


def _halves(p: np.ndarray, margin: float, band: float) -> tuple[float, float]:
    """Cut between the 40th and 60th percentile with the fewest rows within the margin, and the margin,
    narrowed where more than the share ``band`` of rows would be in it."""
    order, n = np.sort(p), len(p)
    at = np.unique(np.linspace(0.4 * n, 0.6 * n, 11).astype(int).clip(1, n - 1))
    cuts = (order[at - 1] + order[at]) / 2
    inside = np.searchsorted(order, cuts + margin, "right") - np.searchsorted(order, cuts - margin, "right")
    best = np.lexsort((np.abs(at - n / 2), inside))[0]
    cut, within = float(cuts[best]), int(band * n)
    if inside[best] > within:
        margin = float(np.partition(np.abs(order - cut), within)[within])
    return cut, margin


def fit(x: np.ndarray, share: float, s: Settings, spill: float, rng: np.random.Generator) -> Tree:
    """A tree over a sample of a leaf. share: rows that a row of the sample stands for. All nodes of a level
    use one direction. A node is done if few rows are left, if it is dense, or if no split makes it smaller;
    one with too small a sample is fitted again in the next round."""
    levels = 2 + math.ceil(math.log(max(2.0, len(x) * share / s.leaf)) / -math.log((1 + s.band) / 2 + 0.05))
    directions = rng.standard_normal((levels, x.shape[1]))
    directions /= np.sqrt((directions**2).sum(axis=1, keepdims=True))
    at, wide = x @ directions.T, spill * math.sqrt(2 - 2 * s.threshold) / math.sqrt(x.shape[1])
    low, high, cut, margin, level, done, centre, centres = [-1], [-1], [0.0], [0.0], [0], [True], [-1], []
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * share <= s.leaf:
            continue
        if len(rows) < s.least_sample or level[node] == levels:
            done[node] = False
            continue
        if _dense(x[rows], s.threshold):
            mean = x[rows].mean(axis=0)
            centre[node] = len(centres)
            centres.append(mean / np.sqrt((mean * mean).sum()))
            continue
        p = at[rows, level[node]]
        c, m = _halves(p, wide, s.band)
        a, b = rows[p <= c + m], rows[p > c - m]
        if len(a) + len(b) > 1.3 * len(rows) or not len(a) or not len(b):
            continue
        cut[node], margin[node], low[node], high[node] = c, m, len(low), len(low) + 1
        for part in (a, b):
            todo.append((len(low), part))
            for column, value in ((low, -1), (high, -1), (cut, 0.0), (margin, 0.0), (level, level[node] + 1), (done, True), (centre, -1)):
                column.append(value)
    return Tree(directions, np.array(low), np.array(high), np.array(cut), np.array(margin), np.array(level), np.array(done), np.array(centre), np.array(centres))


def route(x: np.ndarray, t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaf nodes: a row in the band around a split goes both ways."""
    at = x @ t.directions.T
    rows, nodes, ended = np.arange(len(x)), np.zeros(len(x), np.int64), []
    while len(rows):
        leaf = t.low[nodes] < 0
        ended.append((rows[leaf], nodes[leaf]))
        rows, nodes = rows[~leaf], nodes[~leaf]
        p = at[rows, t.level[nodes]]
        down, up = p <= t.cut[nodes] + t.margin[nodes], p > t.cut[nodes] - t.margin[nodes]
        rows, nodes = np.concatenate([rows[down], rows[up]]), np.concatenate([t.low[nodes[down]], t.high[nodes[up]]])
    return np.concatenate([r for r, _ in ended]), np.concatenate([n for _, n in ended])


def _leaf_ids(tree: int, leaf: int, nodes: np.ndarray) -> np.ndarray:
    """Numbers of the leaves below one, apart from those of other leaves and trees."""
    with np.errstate(over="ignore"):
        h = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (np.uint64(leaf % (1 << 64)) + np.uint64(tree + 2)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _fitted(rows: DataFrame, trees: list[int], s: Settings, spill: float, turn: int) -> DataFrame:
    """tree, leaf, fitted (a pickled Tree) of the leaves that rows are in: fitted in the executors, each leaf on
    a bounded sample of its own."""
    each = [min(s.sample_rows, max(1024, s.sample_bytes // (8 * n))) for (n,) in rows.select(F.size("v")).limit(1).collect()][0]
    sizes = written(rows.groupBy("tree", "leaf").agg(F.count("*").alias("rows")), "sizes")
    chosen = rows.join(sizes, ["tree", "leaf"]).where(F.pmod(F.xxhash64("cid", "leaf", F.lit(turn)), F.lit(1 << 30)) < (1 << 30) * F.least(F.lit(1.0), each / F.col("rows")))
    if turn == 0:
        chosen = chosen.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in trees])))

    def learn(group: pa.Table) -> pa.Table:
        tree, leaf, x = group["tree"][0].as_py(), group["leaf"][0].as_py(), _matrix(group["v"].combine_chunks())
        t = fit(x, group["rows"][0].as_py() / len(x), s, spill, np.random.default_rng([s.seed, tree + 1, leaf % (1 << 63), turn]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int64()), "fitted": pa.array([pickle.dumps(t)], pa.binary())})

    return written(chosen.select("tree", "leaf", "rows", "v").groupBy("tree", "leaf").applyInArrow(learn, "tree int, leaf long, fitted binary"), "trees")


def placed(vectors: DataFrame, trees: list[int], s: Settings, spill: float) -> DataFrame:
    """cid, tree, leaf, core of all vectors (cid, v: of one dimension, valid) in these trees.

    core: whether the leaf is dense and the vector within half of the limiting angle of its centre. One round
    fits trees on samples and routes every row; leaves whose samples became too small go through another, whose
    trees are broadcast in portions of a set size. Rows of finished leaves are written once."""
    kind, half = dict(vectors.dtypes)["v"], math.cos(math.acos(s.threshold) / 2) + 1e-12
    rows, turn, out = vectors.select("cid", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf"), "v"), 0, []
    while True:
        known = _fitted(rows, trees, s, spill, turn)
        portions = -(-(known.agg(F.sum(F.octet_length("fitted"))).first()[0] or 1) // s.broadcast_bytes)
        for i in range(portions):
            mine = F.pmod(F.xxhash64("leaf", F.lit(7)), F.lit(portions)) == i
            sent = vectors.sparkSession.sparkContext.broadcast({(r["tree"], r["leaf"]): r["fitted"] for r in known.where(mine).toLocalIterator()})

            def run(batches: Iterator[pa.RecordBatch], sent=sent, first=turn == 0) -> Iterator[pa.RecordBatch]:
                opened: dict[tuple[int, int], Tree] = {}
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, cid, v = _matrix(batch.column(3)), batch.column(0), batch.column(3)
                    keys = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
                    for tree, leaf in [(t, 0) for t in trees] if first else {*zip(*keys.tolist())}:
                        at = np.arange(len(x)) if first else np.flatnonzero((keys[0] == tree) & (keys[1] == leaf))
                        if (tree, leaf) not in opened:
                            opened[tree, leaf] = pickle.loads(sent.value[tree, leaf])
                        t = opened[tree, leaf]
                        i, node = route(x[at], t)
                        core = np.zeros(len(i), bool)
                        dense = np.flatnonzero(t.centre[node] >= 0)
                        if len(dense):
                            core[dense] = (x[at[i[dense]]] * t.centres[t.centre[node[dense]]]).sum(axis=1) >= half
                        take, done = pa.array(at[i]), t.done[node]
                        kept = v.take(take) if not done.all() else pa.nulls(len(i), v.type)
                        columns = [cid.take(take), pa.array(np.full(len(i), tree, np.int32)), pa.array(_leaf_ids(tree, leaf, node)), kept, pa.array(core), pa.array(done)]
                        yield pa.RecordBatch.from_arrays(columns, ["cid", "tree", "leaf", "v", "core", "done"])

            some = written(rows.where(mine).mapInArrow(run, f"cid long, tree int, leaf long, v {kind}, core boolean, done boolean"), f"round-{turn}")
            out.append(some)
        finished = [o.where("done").select("cid", "tree", "leaf", "core") for o in out]
        rest = [o.where("not done").select("cid", "tree", "leaf", "v") for o in out[-portions:]]
        rows, turn = rest[0], turn + 1
        for r in rest[1:]:
            rows = rows.unionByName(r)
        if rows.isEmpty():
            break
    result = finished[0]
    for f in finished[1:]:
        result = result.unionByName(f)
    return result


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row joined with each row by the pairs a, b and what the labels say so far."""
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _apart(lists: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the lists of rows a and b, pair by pair, have nothing in common: each row's list as bits."""
    if not len(a):
        return np.zeros(0, bool)
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    lists = lists.take(pa.array(used))
    row = np.repeat(np.arange(len(used)), np.diff(lists.offsets.to_numpy()))
    values, bit = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    has = np.zeros((len(used), max(1, len(values))), bool)
    has[row, bit] = True
    bits, (x, y) = np.packbits(has, axis=1), place.reshape(2, -1)
    return np.concatenate([~(bits[x[i : i + 50_000]] & bits[y[i : i + 50_000]]).any(axis=1) for i in range(0, len(x), 50_000)])


def _dealt(rows: DataFrame, large: DataFrame, places: DataFrame, s: Settings) -> DataFrame:
    """Rows (with tree, leaf, before) in the pairs of blocks (i, j) in which their leaf is compared, and their own block.

    A leaf that is too large for one task is cut into blocks, and each pair of blocks is a task of its own. Two rows that
    were together in a large leaf of a tree before have been compared there, and two of one clique needn't be: rows go to
    blocks by the first large leaf that they were in (their owner) and by whether they are in a clique, and pairs of blocks
    with one owner, or within one clique, are left out. So a dense group that no tree splits is compared once."""
    most = 500_000
    few = lambda df: F.broadcast(df) if df.count() <= most else df
    own = places.select("cid", F.explode("places").alias("at")).select("cid", "at.tree", "at.leaf").join(few(large), "leaf")
    bigs = own.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("tree", "leaf"))).alias("bigs"))
    marked = rows.join(few(large).withColumn("is_large", F.lit(True)), "leaf", "left")
    small = marked.where("is_large is null").withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})
    owner = F.expr("get(filter(bigs, p -> p.tree < tree or (p.tree = tree and p.leaf < leaf)), 0).leaf")
    inside = written(marked.where("is_large").join(bigs, "cid").withColumn("owner", owner).drop("bigs", "is_large"), "in-large-leaves")
    kind = ["leaf", "owner", "bound"]
    inside = inside.withColumn("bound", F.col("clique").isNotNull())
    groups = inside.groupBy(*kind).agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"), F.min("clique").alias("lo"), F.max("clique").alias("hi"))
    first = F.sum("blocks").over(Window.partitionBy("leaf").orderBy("owner", "bound").rowsBetween(Window.unboundedPreceding, -1))
    groups = written(groups.withColumn("first", F.coalesce(first, F.lit(0)).cast("int")), "block-groups")
    # Of a group within one clique, which one it is; none for others.
    each = groups.select("leaf", "owner", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("clique"), F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("block"))
    x, y = (each.select("leaf", *[F.col(c).alias(f"{c}{n}") for c in ("owner", "clique", "block")]) for n in "12")
    again = F.coalesce(F.col("owner1") == F.col("owner2"), F.lit(False)) | F.coalesce(F.col("clique1") == F.col("clique2"), F.lit(False))
    pairs = x.join(y, "leaf").where((F.col("block1") <= F.col("block2")) & ~again).select("leaf", F.col("block1").alias("i"), F.col("block2").alias("j"))
    met = pairs.select("leaf", F.col("i").alias("block"), "i", "j").unionByName(pairs.where("i < j").select("leaf", F.col("j").alias("block"), "i", "j"))
    met = written(met.groupBy("leaf", "block").agg(F.collect_list(F.struct("i", "j")).alias("met")), "block-pairs")
    sizes = groups.select("leaf", F.col("owner").alias("of"), F.col("bound").alias("kind"), "blocks", "first")
    placed_in = inside.join(few(sizes), "leaf").where(F.col("owner").eqNullSafe(F.col("of")) & (F.col("bound") == F.col("kind")))
    placed_in = placed_in.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("cid"), F.col("blocks"))).cast("int"))
    out = placed_in.join(few(met), ["leaf", "block"]).withColumn("p", F.explode("met")).select("leaf", "block", "cid", "v", "copies", "clique", "before", "p.i", "p.j")
    return out.unionByName(small.select(*out.columns))


def linked(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """cid, others, joined: rows that say how many vectors link with one (cid, v, copies: of one dimension,
    valid, all different), and a vector that it is joined with. Several rows of one cid add up.

    A leaf of any size is whole: large ones are compared in blocks, each pair of blocks in a task of its own, and what
    has been compared in a large leaf of an earlier tree, or links as a clique, isn't compared again."""
    s = settings
    vectors = written(vectors.select("cid", "v", "copies"), "different-vectors")
    dense = placed(vectors, [-1], s, 0.0).where("core").groupBy("cid").agg(F.min("leaf").alias("clique"))
    dense = written(dense, "dense")
    small = dense.count() <= 500_000
    rows = written(vectors.join(F.broadcast(dense) if small else dense, "cid", "left"), "with-cliques")
    groups = rows.where("clique is not null").groupBy("clique").agg(F.sum("copies").alias("all"), F.min("cid").alias("joined"))
    members = dense.join(vectors.select("cid", "copies"), "cid").join(F.broadcast(groups) if small else groups, "clique")
    members = members.select("cid", (F.col("all") - F.col("copies")).alias("others"), "joined")

    places = placed(vectors, list(range(s.trees)), s, s.spill).select("cid", F.struct("tree", "leaf").alias("at"))
    places = written(places.groupBy("cid").agg(F.collect_list("at").alias("places")), "places")  # a few a tree
    at = rows.join(places, "cid").select("cid", "v", "copies", "clique", "places", F.explode("places").alias("at"))
    rows = at.select("cid", "v", "copies", "clique", "at.tree", "at.leaf", F.expr("transform(filter(places, p -> p.tree < at.tree or (p.tree = at.tree and p.leaf < at.leaf)), p -> p.leaf)").alias("before"))
    counts = places.select(F.explode("places").alias("at")).select("at.leaf").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * s.leaf)
    large = written(counts.select("leaf"), "large-leaves")
    if large.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})
    else:
        rows = _dealt(rows, large, places, s)
    rows = rows.select("leaf", "i", "j", "block", "cid", "v", "copies", F.coalesce("clique", F.lit(0)).alias("clique"), "before")

    def compare(group: pa.Table) -> pa.Table:
        cid, block, copies, clique = (group[c].to_numpy() for c in ("cid", "block", "copies", "clique"))
        x, i, j = _matrix(group["v"].combine_chunks()), group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        before, n, label = group["before"].combine_chunks(), np.zeros(len(cid)), np.arange(len(cid))
        for some in np.array_split(left, max(1, -(-len(left) // 256))):
            product = x[some] @ x[right].T
            at, to = np.nonzero(product >= s.threshold - 1e-9)
            a, b, exact = some[at], right[to], product[at, to]
            wanted = ((i != j) | (a < b)) & ((clique[a] != clique[b]) | (clique[a] == 0))
            a, b, exact = a[wanted], b[wanted], exact[wanted]
            # At the threshold what counts is the sum in one order, whatever the product's.
            edge = np.abs(exact - s.threshold) <= 1e-9
            exact[edge] = (x[a[edge]] * x[b[edge]]).sum(axis=1)
            a, b = a[exact >= s.threshold], b[exact >= s.threshold]
            label = _labels(label, a, b)
            new = _apart(before, a, b)
            n += np.bincount(a[new], copies[b[new]], len(cid)) + np.bincount(b[new], copies[a[new]], len(cid))
        some = np.flatnonzero((n > 0) | (label != np.arange(len(cid))))
        return pa.table({"cid": cid[some], "others": n[some].astype(np.int64), "joined": cid[label[some]]})

    found = rows.groupBy("leaf", "i", "j").applyInArrow(compare, "cid long, others long, joined long")
    return found.unionByName(members)


def cluster(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: id, n_links (others linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different dimension don't link. Equal vectors are one class that enters the forest once and count as links
    of each other, so any number of copies costs one row. Repeated ids are vectors of their own; null ids
    stay, and name a component only where no other id does. An empty table gives no rows; other columns aren't
    read. Links that the forest misses are missing from all columns alike.
    """
    given = dict(vectors.dtypes)[vector_col]
    own = F.col(vector_col) if given in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), own.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # 0.0 and -0.0 are one number but hash apart.
    rows = rows.select("id", F.when(F.coalesce(finite, F.lit(False)), F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))).alias("v"))
    rows = written(rows.withColumns({"h": F.xxhash64("v"), "k": F.xxhash64(F.lit(1), "v")}), "vectors")
    alone = lambda r: r.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    classes = rows.where("v is not null").groupBy("h", "k").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = None
    for (size,) in classes.select(F.size("v")).distinct().collect():  # dimensions in use: one, as a rule
        some = linked(classes.where(F.size("v") == size), settings)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return alone(rows)
    found = written(found, "links")
    links = found.groupBy("cid").agg(F.sum("others").alias("others"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("joined").alias("b"))).withColumnRenamed("node", "cid")
    named = written(classes.select("h", "k", "cid", "least", "copies").join(links, "cid", "left").join(joined, "cid", "left"), "named")
    names = named.where("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    named = with_classes(named.where("component is not null"), names, "component").unionByName(named.where("component is null").withColumn("name", F.lit(None).cast("long")))
    named = written(named.select("h", "k", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("name", "least").alias("name")), "names")
    valid = with_classes(rows.where("v is not null").select("id", "h", "k"), named, "h", "k")
    component = F.coalesce("name", "id")
    out = valid.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    return out.unionByName(alone(rows.where("v is null")))
