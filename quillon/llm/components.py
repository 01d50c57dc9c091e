"""Connected components by alternating large-star and small-star rounds, as joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.llm import common


#: Rows of a node from which it is a hub, unless the 100,000th part of all edges is more.
HUB = 10_000
#: Edges a task of a round's last step gets at least, if there are more tasks than cores.
TASK = 1_000_000


def _digest(both: DataFrame) -> tuple:
    """(rows, hash of all rows, most rows of a node) of edges both ways, combined before they are shuffled."""
    per = both.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("h"))
    row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
    return row.n, row.h, row.most or 0


def _beside_least(rows: DataFrame, low: DataFrame, hub: int, most: int) -> DataFrame:
    """rows (a, b) with m of low (a, m, n: a's number of rows). Nodes of over `hub` rows, if there are any, are
    joined by a broadcast, so that no task gets a whole hub: of e rows, at most 100,000 nodes have more than
    the 100,000th part. The others meet in a plain equi-join."""
    if most <= hub:
        return rows.join(low.select("a", "m"), "a").select("a", "b", "m")
    marked = rows.join(F.broadcast(low.where(F.col("n") > hub).select("a", "m")), "a", "left")
    rest = marked.where("m is null").drop("m").join(low.where(F.col("n") <= hub).select("a", "m"), "a")
    return marked.where("m is not null").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), undirected -> (node, root): every node that an edge names, with the
    smallest node of its component.

    Each round leaves every node linked to smaller ones only and ends when nothing changes; the
    result is then a star around each root. Aggregates are minima, combined before they are
    shuffled; a large hub's rows are not brought together. Every round is written to the shared folder, and the
    one before it removed."""
    now = common.cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _digest(_both_ways(now))
    while seen[0]:
        both, most = _both_ways(now), seen[2]
        hub = max(HUB, seen[0] // 100_000)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _beside_least(both, low, hub, most).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _beside_least(large, low, hub, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-seen[0] // TASK))  # few edges make few files
        before, now = now, common.cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
        common.discard(before)
        found = _digest(_both_ways(now))
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
