"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_stored, stored


#: Neighbours of a node that one join key holds; a node with more is dealt out over several. Raised so that at most
#: MOST_HOT nodes, 16 bytes each, are broadcast.
NEIGHBOURS, MOST_HOT = 1000, 1 << 21


def _fewer(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges (a, b) with m of least (a, m, n; n: edges of a): the edges of a hot node meet its m in parts."""
    bound = max(NEIGHBOURS, 2 * n_edges // MOST_HOT)
    hot = least.where(F.col("n") > bound).select("a", (F.floor(F.col("n") / bound) + 1).alias("parts"))
    dealt = edges.join(F.broadcast(hot), "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)))
    parts = F.when(F.col("n") > bound, F.floor(F.col("n") / bound)).otherwise(0)
    each = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"))
    return dealt.join(each, ["a", "part"]).select("a", "b", "m")


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _fewer(_with_least(both.where("b > a"), least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")))


def small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return _fewer(_with_least(down, least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node that ``edges`` (a, b) name.

    Hot nodes are met by partial minima before each shuffle and by joins in parts.
    Each round's edges are written to the shared folder, which cuts lineage; the
    loop ends when a round leaves the edges as they were. No edges: no rows.
    """
    now = stored(_fewer(edges), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
        after = stored(small_star(large_star(now, seen[0]), seen[0]), "edges")
        drop_stored(now)
        now = after
