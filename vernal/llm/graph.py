"""Connected components of a link table, distributed: alternating large-star and small-star
contraction, each round written to the shared folder. Nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.sources.scratch import drop, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. Minimum by node first (partial sums on the map side), then a join, whose hot keys Spark can split."""
    if large:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.join(low, "a").select("a", F.greatest("b", "a").alias("up") if large else F.col("b").alias("up"), F.col("b").alias("other"), "m")
    if large:  # every larger neighbour points to the least neighbour
        return out.where("other > a").select(F.col("other").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # the node and its smaller neighbours point to the least of them
    return out.select(F.col("other").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of long nodes, any order, repeats and self-links allowed, to (node, root): root is the
    least node reachable. Nodes without a link to another node are left out; null ends are ignored."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        then = written(_star(_star(now, True), False), "links")
        drop(now.sparkSession, now.path)
        now = then
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(row)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
