"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

At each level a document draws, for every child of the node that it has reached, an exponential number with
the child's weight as rate, from a hash of its id and the child's name; the least draw wins. A child wins in
proportion to its weight, and a change of weights below a node moves documents only into or out of the
children whose weights changed: movement stays inside those subtrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: A tree is {region: {rack: {shard: weight}}}.
Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int, base: int = 24, racks: int = 3, per_rack: int = 4) -> Tree:
    """The tree of so many equal shards: those under ``base`` fill racks and regions in order; each shard
    added later stands in a region of its own (a new failure domain), so it only takes documents."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = (f"r{s // (racks * per_rack)}", f"k{s // per_rack % racks}") if s < base else (f"r+{s}", "k0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _children(tree: Tree) -> dict[str, list[tuple[str, float, int | None]]]:
    """For each inner node, by its path, the (path, weight, shard) of its children that have weight."""
    found: dict[str, list] = {}

    def visit(path: str, node) -> None:
        found[path] = [(f"{path}/{name}", _weight(child), None if isinstance(child, dict) else name) for name, child in node.items() if _weight(child) > 0]
        if not found[path]:
            raise ValueError(f"no weight below {path or 'the root'}")
        for name, child in node.items():
            if isinstance(child, dict) and _weight(child) > 0:
                visit(f"{path}/{name}", child)

    visit("", tree)
    return found


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight for u in (0, 1] from 53 bits of the hash of key and node."""
    u = (F.shiftrightunsigned(F.xxhash64(key, path), 11).cast("double") + 1) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a key: the key and the tree decide, nothing else. A null key is a key like others.

    The tree goes in as one literal map from node to children; each of the three levels looks up the node
    reached and keeps the child with the least draw."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    child = lambda path, weight, shard: F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight"), F.lit(shard).cast("int").alias("shard"))
    entries = [x for path, options in _children(tree).items() for x in (F.lit(path), F.array(*[child(*o) for o in options]))]
    reached = F.struct(F.lit("").alias("path"))
    for _ in range(3):
        options = F.element_at(F.create_map(*entries), reached["path"])
        reached = F.array_min(F.transform(options, lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path"), c["shard"].alias("shard"))))
    return reached["shard"]


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", per_slot_group: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row.

    size: UTF-8 bytes of the text (null: none) plus 8. slot: gapless from 0 in each shard. grown_shard: the
    shard in the tree ``grown``, null without one. Repeated rows get slots of their own; null ids form one
    key; an empty table gives no rows; other columns aren't read.

    Equal rows are counted before the shuffle and spread out again at the end, so any number of copies moves
    as one row. Slots come from two sums: within buckets of a shard, whose number grows with the input
    (``per_slot_group`` rows each), and over the buckets' totals.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    counted = written(counted, "counted")
    buckets = max(64, -(-counted.count() // (per_slot_group * 24)))
    keyed = counted.select(
        "*",
        shard_of(F.col("doc_id"), tree).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).alias("bucket"),
    )
    totals = keyed.groupBy("shard", "bucket").agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, ["shard", "bucket"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_copy")
    return placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "_before", "_inside", copies).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_inside") + F.col("_copy")).cast("long").alias("slot"), "grown_shard"
    )
