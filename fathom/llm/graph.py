"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b", salts: int = 16) -> DataFrame:
    """node, component (the smallest node reachable) of every node in a link.

    Each round hangs a node's larger neighbours, then the node and its smaller ones, under the smallest
    neighbour (Kiveris et al., "Connected Components in MapReduce and Beyond"), and writes the links: the number
    of rounds follows the logarithm of the longest path. A node's links meet its smallest neighbour in ``salts``
    places, by their other ends, so a hub of a third of all links isn't one task's. Self links and repeated
    links do no harm; an empty table gives no rows.
    """
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("s")
    edges = written(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("s"))
        large = both.where("v > u").withColumn("s", salt("v")).join(least, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # In a small star every neighbour is smaller than the node, of which there are few.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, written(small, "links")
        forget(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def extended(joined: DataFrame, links: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """Components (node, component) after more links a, b: these are links of components now, which are far
    fewer, so the rounds run on them alone."""
    of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    moved = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = written(moved.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct(), "moved")
    if moved.isEmpty():
        return joined
    roots = written(components(moved), "roots")
    forget(moved)
    names = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    names = F.broadcast(names) if names.count() <= broadcast_rows else names
    old = joined.join(names, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return written(old.unionByName(roots.join(joined, "node", "left_anti")), "joined-again")
